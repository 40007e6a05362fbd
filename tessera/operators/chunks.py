"""Sections of Markdown files cut into chunks for retrieval, at the coarsest break that fits, with what the headings say about each."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import sections
from tessera.registry import query

SIZE, OVERLAP = 1000, 100
#: Coarse to fine; where none is left, characters.
MARKS = ("\n\n", "\n", " ")


def _joined(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbours joined while they fit; the next chunk begins with as many of the last one's parts as make up at most `overlap`."""
    first = held = 0
    for i, part in enumerate(parts):
        if held + len(part) > size:
            yield "".join(parts[first:i])
            while first < i and (held > overlap or held + len(part) > size):
                held -= len(parts[first])
                first += 1
        held += len(part)
    yield "".join(parts[first:])


def _cut(text: str, size: int, overlap: int, level: int) -> Iterator[str]:
    level = next((k for k in range(level, len(MARKS)) if MARKS[k] in text), len(MARKS))
    if level == len(MARKS):
        parts = list(text)
    else:
        head, *rest = text.split(MARKS[level])
        parts = [head] * bool(head) + [MARKS[level] + r for r in rest]  # a mark stays with what follows it
    for long, run in groupby(parts, lambda p: len(p) >= size):
        if long and level < len(MARKS):
            for part in run:
                yield from _cut(part, size, overlap, level + 1)
        else:
            yield from _joined(list(run), size, overlap)


def recursive_chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Chunks of at most `size` characters, without blanks at their ends; null and blank texts have none.

    A text is split at the coarsest mark in it. Parts shorter than `size` are joined, longer ones split at the next finer mark."""
    yield from (c for chunk in _cut(text or "", size, overlap, 0) if (c := chunk.strip()))


@F.udtf(returnType="piece int, chunk string")
class RecursiveChunks:
    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(recursive_chunks(text, size, overlap))


def section_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """source, position, chunk, metadata (source, H1, H2, H3) of the files (source, text); a section's text begins with its path."""
    spark = files.sparkSession
    spark.udtf.register("recursive_chunks", RecursiveChunks)
    cut = spark.sql("select s.*, c.piece, c.chunk from {sections} s, lateral recursive_chunks(s.text, {size}, {overlap}) c", sections=sections(files, headings=True), size=size, overlap=overlap)
    turn = F.row_number().over(Window.partitionBy("source").orderBy("section", "piece")) - 1
    return cut.select("source", turn.alias("position"), "chunk", F.struct("source", F.col("h1").alias("H1"), F.col("h2").alias("H2"), F.col("h3").alias("H3")).alias("metadata"))


#: Files whose body has paragraphs, and headings of all three levels.
_BODY = "concat('# Title', chr(10), text, chr(10), '## Notes', chr(10), replace(text, '. ', concat('.', chr(10), chr(10))), chr(10), '### More', chr(10), 'end', chr(10), '# Last', chr(10), replace(text, ' ', '-'))"
#: The same as a recursion over nodes, and one over the chunks of each run of parts.
_CHUNKS = rf"""with recursive d as (select cast(doc_id as varchar) as source, string_split({_BODY}, chr(10)) as rows from documents where text is not null),
l as (select source, unnest(rows) as row, unnest(range(len(rows))) as line from d),
m as (select *, length(regexp_extract(row, '^(#{{1,3}})\s+\S', 1)) as level, trim(regexp_replace(row, '^#{{1,3}}\s+', '')) as name from l),
h as (select *, cast(sum(case when level > 0 then 1 else 0 end) over s as bigint) as section, last_value(case when level = 1 then name end ignore nulls) over s as h1,
  last_value(case when level = 2 then name when level = 1 then '' end ignore nulls) over s as h2, last_value(case when level = 3 then name when level in (1, 2) then '' end ignore nulls) over s as h3
  from m window s as (partition by source order by line)),
p as (select source, section, nullif(max(h1), '') as h1, nullif(max(h2), '') as h2, nullif(max(h3), '') as h3, string_agg(row, chr(10) order by line) as body from h group by source, section),
q as (select source, section, h1, h2, h3, concat('[', array_to_string(list_filter([h1, h2, h3], lambda x: x is not null), ' > '), ']', chr(10), body) as text from p where trim(body) <> ''),
n(source, section, place, least, text, level) as (
  select source, section, [cast(0 as bigint)], 1, text, case when contains(text, chr(10) || chr(10)) then 1 when contains(text, chr(10)) then 2 when contains(text, ' ') then 3 else 4 end from q
  union all select source, section, list_append(place, k), level + 1, part, case when level < 2 and contains(part, chr(10)) then 2 when level < 3 and contains(part, ' ') then 3 else 4 end
  from (select source, section, place, level, unnest(parts) as part, unnest(range(len(parts))) as k from
    (select *, string_split(text, mark) as cut, list_filter(list_transform(range(1, len(cut) + 1), lambda i: case when i > 1 then mark else '' end || cut[i]), lambda x: x <> '') as parts
     from (select *, case level when 1 then chr(10) || chr(10) when 2 then chr(10) else ' ' end as mark from n where level < 4))) where length(part) >= {SIZE}),
a as (select source, section, place, unnest(parts) as part, unnest(range(len(parts))) as k from
  (select *, case level when 1 then chr(10) || chr(10) when 2 then chr(10) when 3 then ' ' else '' end as mark, string_split(text, mark) as cut,
    case when level = 4 then cut else list_filter(list_transform(range(1, len(cut) + 1), lambda i: case when i > 1 then mark else '' end || cut[i]), lambda x: x <> '') end as parts from n)),
b as (select *, sum(case when length(part) >= {SIZE} then 1 else 0 end) over (partition by source, section, place order by k) as run from a),
r as (select *, sum(length(part)) over (partition by source, section, place, run order by k) as upto from b where length(part) < {SIZE}),
e as (select source, section, list_append(place, min(k)) as place, list(part order by k) as parts, list_prepend(0, list(upto order by k)) as sums from r group by source, section, place, run),
c as (select source, section, place, parts, sums, 0 as piece, 0 as a, coalesce(list_min(list_filter(range(1, len(parts)), lambda j: sums[j + 2] > {SIZE})), len(parts)) as z from e
  union all select source, section, place, parts, sums, piece + 1, b, coalesce(list_min(list_filter(range(z + 1, len(parts)), lambda j: sums[j + 2] - sums[b + 1] > {SIZE})), len(parts))
  from (select *, list_min(list_filter(range(a, z + 1), lambda i: i = z or (sums[z + 1] - sums[i + 1] <= {OVERLAP} and sums[z + 2] - sums[i + 1] <= {SIZE}))) as b from c where z < len(parts))),
f as (select source, section, place, piece, trim(array_to_string(parts[a + 1 : z], ''), concat(' ', chr(10), chr(9), chr(13))) as chunk from c),
g as (select f.source, row_number() over (partition by f.source order by f.section, place, piece) - 1 as position, chunk, h1, h2, h3 from f join q on q.source = f.source and q.section = f.section where chunk <> '')
"""


def _files(t) -> DataFrame:
    return t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("source"), F.expr(_BODY).alias("text"))


query("doc_chunk_sections", _CHUNKS + "select source, cast(position as int) as position, chunk from g")(lambda t: section_chunks(_files(t)).select("source", "position", "chunk"))
query("doc_metadata_sections", _CHUNKS + "select cast(position as int) as position, struct_pack(source := source, H1 := h1, H2 := h2, H3 := h3) as metadata from g")(lambda t: section_chunks(_files(t)).select("position", "metadata"))


def routes(questions: DataFrame) -> DataFrame:
    """Of questions(id, verdict, documents): the kind that a model's verdict names (system, chess or chitchat; anything else is system),
    and the steps that answer it. Only system questions are rewritten and looked up; without a document they get no context."""
    kind = F.lower(F.regexp_replace(F.regexp_replace("verdict", r"^\s+|\s+$", ""), "^['\"]+|['\"]+$", ""))
    kind = F.when(kind.isin("system", "chess", "chitchat"), kind).otherwise(F.lit("system"))
    looked = F.array(F.lit("rewrite_question"), F.lit("retrieve"), F.when(F.coalesce("documents", F.lit(0)) > 0, "generate_rag").otherwise("no_context_answer"))
    steps = F.when(F.col("kind") == "system", looked).when(F.col("kind") == "chess", F.array(F.lit("generate_direct"))).otherwise(F.array(F.lit("generate_chitchat")))
    return questions.select("id", kind.alias("kind"), "documents").withColumn("steps", F.array_join(steps, " > ")).select("id", "kind", "steps")


#: Verdicts as a model may write them; chunks of a label stand for what is found.
_ASKED = """select session_id * 1000 + seq as id, case (session_id + seq) % 6 when 0 then ' System ' when 1 then '"chess"' when 2 then '''chitchat''' when 3 then 'CHESS' when 4 then 'no idea' else '' end as verdict,
  n.documents from chat_messages m left join (select label, count(*) as documents from chunks group by label) n on n.label = m.seq + m.session_id % 9 where role = 'user'"""
query("route_question_branches", f"""with q as ({_ASKED}), k as (select id, documents, case when verdict in ('"chess"', 'CHESS') then 'chess' when verdict = '''chitchat''' then 'chitchat' else 'system' end as kind from q)
select id, kind, case kind when 'chess' then 'generate_direct' when 'chitchat' then 'generate_chitchat' else concat('rewrite_question > retrieve > ', case when documents is null then 'no_context_answer' else 'generate_rag' end) end as steps from k""")(
    lambda t: routes(t.sql(_ASKED))
)
