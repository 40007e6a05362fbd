"""Chat sessions, documents and vectors."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import cosine, dot
from tessera.operators.vectors import fit_centroids, into_lists, search, search_lists
from tessera.registry import plain, query
from tessera.sources.files import fresh_folder

def top_k(chunks: DataFrame, question: DataFrame, k: int = 4) -> DataFrame:
    """The k nearest chunks by cosine to the vector of a one-row table, exactly: a partial top k in every task."""
    asked = question.limit(1).select(F.col(question.columns[0]).alias("asked"))
    return chunks.join(F.broadcast(asked)).withColumn("score", cosine(F.col("embedding"), F.col("asked"))).drop("asked").orderBy(F.desc("score"), "id").limit(k)


def top_k_l2(chunks: DataFrame, question: DataFrame, k: int = 4) -> DataFrame:
    """As top_k, by Euclidean distance."""
    asked = question.limit(1).select(F.col(question.columns[0]).alias("asked"))
    apart = F.zip_with("embedding", "asked", lambda x, y: x.cast("double") - y)
    return chunks.join(F.broadcast(asked)).withColumn("distance", F.sqrt(dot(apart, apart))).drop("asked").orderBy("distance", "id").limit(k)


def embed(rows: DataFrame, id_col: str, text_col: str, size: int = 64, kind: str = "float") -> DataFrame:
    """id and embedding: a vector of length 1 of numbers of that kind from hashed lower-case words, without a trained model; zeros
    without words. Ids are distinct. Words are counted by cell before anything is shuffled."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cell = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % size
    cells = rows.select(id_col, F.explode_outer(words).alias("word")).groupBy(id_col, cell.cast("int").alias("cell")).agg(F.count("word").alias("n"))
    counts = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n")))).alias("counts"))  # at most `size` entries
    norm = F.sqrt(F.aggregate(F.map_values("counts"), F.lit(0.0), lambda s, n: s + n * n))
    at = lambda k: F.coalesce(F.try_element_at("counts", k), F.lit(0)) / F.greatest(norm, F.lit(1.0))
    return counts.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: at(k).cast(kind)).alias("embedding"))


def context(chunks: DataFrame, key: str, order: str, text: str) -> Column:
    cells = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.concat_ws("\n\n", F.transform(cells, lambda c: c[text]))


def pruned_history(messages: DataFrame, most: int = 6, keep: int = 2) -> DataFrame:
    """Of sessions with `most` or more messages, all but the last `keep` are to be summed up."""
    whole = Window.partitionBy("session_id")
    m = messages.withColumn("n", F.count("*").over(whole)).withColumn("back", F.row_number().over(whole.orderBy(F.desc("seq"))))
    return m.withColumn("summarise", (F.col("n") >= most) & (F.col("back") > keep))


def sections(files: DataFrame, headings: bool = False) -> DataFrame:
    """Markdown cut at headings of level 1 to 3: source, section, heading path, text (headings stay in it), and if asked for h1, h2, h3.

    files: (source, text). Lines keep their order within a file; nothing crosses files.
    """
    lines = files.select("source", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    lines = lines.withColumn("level", F.length(F.regexp_extract("row", r"^(#{1,3})\s+\S", 1)))
    seen = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(seen))
    for k in (1, 2, 3):
        name = F.when(F.col("level") == k, F.trim(F.regexp_replace("row", r"^#{1,3}\s+", ""))).when((F.col("level") > 0) & (F.col("level") < k), F.lit(""))
        lines = lines.withColumn(f"h{k}", F.nullif(F.last(name, ignorenulls=True).over(seen), F.lit("")))
    cells = F.sort_array(F.collect_list(F.struct("line", "row")))
    out = lines.groupBy("source", "section").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.max("h3").alias("h3"), F.concat_ws("\n", F.transform(cells, lambda c: c["row"])).alias("text"))
    path = F.concat_ws(" > ", "h1", "h2", "h3")
    prefix = F.when(path != "", F.concat(F.lit("["), path, F.lit("]\n"))).otherwise(F.lit(""))
    return out.select("source", "section", path.alias("path"), F.concat(prefix, "text").alias("text"), *["h1", "h2", "h3"] * headings).where(F.trim("text") != "")


def split_text(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Pieces of at most `size` characters that cover the text; each starts up to `overlap` before the last one's end.

    A piece ends at the last paragraph, line or word break that leaves it at least half full."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", " "):
                cut = text.rfind(mark, at + size // 2, end)
                if cut >= 0:
                    end = cut + len(mark)
                    break
        out.append(text[at:end])
        if end == len(text):
            break
        start = end - overlap
        word = text.find(" ", start, end)
        at = max(at + 1, word + 1 if 0 <= word < end - 1 else start)
    return out


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """id, position, chunk of every text; null and empty texts have none."""
    schema = pa.schema([("id", pa.int64()), ("position", pa.int32()), ("chunk", pa.string())])

    def run(batches):
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, c in enumerate(split_text(t or "", size, overlap))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, position int, chunk string")


def image_ids(body: str | None) -> list[str] | None:
    """Ids of the image nodes of a post's tree, in reading order, each once; null unless the root is a document."""
    try:
        root = json.loads(body or "")
    except ValueError:
        return None
    if not isinstance(root, dict) or root.get("type") != "doc":
        return None
    found, stack = {}, [root]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        key = (node.get("attrs") or {}).get("data-public-id") if node.get("type") == "image" else None
        if isinstance(key, str) and key.strip():
            found[key] = None
        stack += reversed(node.get("content") or [])
    return list(found)


@F.pandas_udf(ArrayType(StringType()))
def tree_images(bodies):
    return bodies.map(image_ids)


def _asked(t) -> DataFrame:
    return t.chunks.where("id % 50 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))


def _from_lists(t) -> DataFrame:
    """Through an index of all chunks, stored by list."""
    folder, (centroids, probes) = fresh_folder(t.spark, "lists"), fit_centroids(t.chunks)
    into_lists(t.chunks, centroids, "id", "embedding").repartition("list").write.partitionBy("list").parquet(folder)
    index = t.spark.read.schema("id long, vector array<float>, list int").parquet(folder)
    return search_lists(index, _asked(t), centroids, probes)


_COS = "round(list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])), 4)"
query("topk_vector", f"select c.id, {_COS} as score from chunks c, (select embedding from chunks where id = 0) q order by {_COS} desc, c.id limit 4")(
    lambda t: top_k(t.chunks, t.chunks.where("id = 0").select("embedding")).select("id", F.round("score", 4).alias("score"))
)
query("vec_topk_batch", f"select * from (select q.id as question_id, c.id, {_COS} as score, row_number() over (partition by q.id order by list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])) desc, c.id) as rank from chunks c, (select * from chunks where id % 50 = 0) q) where rank <= 4")(
    lambda t: search(t.chunks, _asked(t)).select("question_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))
)
query("vec_topk_lists")(lambda t: _from_lists(t).select("question_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank")))
query("agg_concat_context", "select session_id, string_agg(content, chr(10) || chr(10) order by seq) as context from chat_messages group by session_id")(lambda t: t.chat_messages.groupBy("session_id").agg(context(t.chat_messages, "session_id", "seq", "content").alias("context")))
query("agg_concat_history", "select session_id, string_agg(role || ': ' || content, chr(10) order by seq) as history from chat_messages group by session_id")(
    lambda t: t.chat_messages.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat("role", F.lit(": "), "content").alias("x")))), lambda c: c["x"]), "\n").alias("history"))
)
query("win_prune", "select session_id, seq, count(*) over (partition by session_id) >= 6 and row_number() over (partition by session_id order by seq desc) > 2 as summarise from chat_messages")(lambda t: pruned_history(t.chat_messages).select("session_id", "seq", "summarise"))
query("doc_split_headers", r"""with d as (select cast(doc_id as varchar) as source, string_split(concat('# Title', chr(10), text, chr(10), '## Notes', chr(10), 'end'), chr(10)) as rows from documents where text is not null),
l as (select source, unnest(rows) as row, unnest(range(len(rows))) as line from d),
m as (select *, length(regexp_extract(row, '^(#{1,3})\s+\S', 1)) as level, trim(regexp_replace(row, '^#{1,3}\s+', '')) as name from l),
h as (select *, cast(sum(case when level > 0 then 1 else 0 end) over s as bigint) as section,
  last_value(case when level = 1 then name end ignore nulls) over s as h1,
  last_value(case when level = 2 then name when level = 1 then '' end ignore nulls) over s as h2,
  last_value(case when level = 3 then name when level in (1, 2) then '' end ignore nulls) over s as h3
  from m window s as (partition by source order by line)),
p as (select source, section, max(h1) as h1, max(h2) as h2, max(h3) as h3, string_agg(row, chr(10) order by line) as body from h group by source, section),
q as (select source, section, body, array_to_string(list_filter([h1, h2, h3], lambda x: coalesce(x, '') <> ''), ' > ') as path from p where trim(body) <> '')
select source, section, path, case when path <> '' then concat('[', path, ']', chr(10)) else '' end || body as text from q""")(lambda t: sections(t.documents.select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("# Title\n"), "text", F.lit("\n## Notes\nend")).alias("text"))))
#: Chunks of 1000 with an overlap of 100, one piece a recursion.
CHUNKS = """with recursive k as (
select doc_id as id, -1 as position, cast(0 as bigint) as a, cast(0 as bigint) as z, cast(0 as bigint) as following, text, length(text) as size from documents where text is not null
union all select id, position + 1, a, z, case when z = size then null else greatest(a + 1, case when instr(substr(text, z - 99, 100), ' ') between 1 and 99 then z - 100 + instr(substr(text, z - 99, 100), ' ') else z - 100 end) end, text, size
from (select *, case when most = size then size when regexp_matches(half, '\\n\\n') then a + 502 + length(regexp_extract(half, '(?s)^(.*)\\n\\n', 1)) when regexp_matches(half, '\\n') then a + 501 + length(regexp_extract(half, '(?s)^(.*)\\n', 1))
    when instr(half, ' ') > 0 then a + 501 + length(regexp_extract(half, '(?s)^(.*) ', 1)) else most end as z
  from (select id, position, following as a, least(following + 1000, size) as most, substr(text, following + 501, least(following + 1000, size) - following - 500) as half, text, size from k where following < size)))
"""
query("doc_chunk", CHUNKS + "select id, position, substr(text, a + 1, z - a) as chunk from k where position >= 0")(lambda t: chunked(t.documents, "doc_id", "text"))
query("json_tree_images", "select id, ['img' || id] as images from users")(
    lambda t: t.users.select("id", tree_images(F.format_string('{"type":"doc","content":[{"type":"p","content":[{"type":"image","attrs":{"data-public-id":"img%s"}}]},{"type":"image","attrs":{"data-public-id":" "}}]}', "id")).alias("images"))
)
for _name, _sql in {
    "scan_select_chat": "select * from chat_sessions where id = 7",
    "filt_ownership": "select m.session_id, m.seq from chat_messages m join chat_sessions s on s.id = m.session_id where s.user_id = 4",
    "agg_count_subquery": "select count(*) as n from (select id from chat_sessions where user_id = 3)",
    "page_1based": "select id, created_at from chat_sessions where user_id = 3 order by created_at desc, id desc limit 2 offset 2",
    "sort_created_asc": "select seq, role from chat_messages where session_id = 5 order by seq",
    "win_history": "select session_id, seq from (select session_id, seq, row_number() over (partition by session_id order by seq desc) as n from chat_messages) where n <= 6",
    "route_question": "select session_id, seq, case when role in ('system', 'user') then role else 'other' end as branch from chat_messages",
    "fn_clean_label": "select session_id, seq, case when role in ('user', 'assistant') then role else 'system' end as label from chat_messages",
    "vec_empty_shortcut": "select s.id, case when count(m.seq) = 0 then 'no_context' else 'answer' end as branch from chat_sessions s left join chat_messages m on m.session_id = s.id + 2 group by s.id",
}.items():
    plain(_name, _sql)
