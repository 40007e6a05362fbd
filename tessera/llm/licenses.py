"""License scans by ordered signature rules. DataFrame functions only.

A text's words are lower-cased and joined by single blanks, and rules are regular expressions over
that (`license_rules`). A text passes the gate if it has a word, or one of a few substrings, that
the rules' keywords need; few do. In those, a rule runs where its own keyword stands. Each match is an interval of words. A detection falls to another
one that covers its interval and has the same or a higher priority; equal intervals keep the first rule.

Edge cases: a null or empty text has no words and no labels; a very long text is scanned whole;
repeated rows are rows of their own; an empty table gives no rows; of a document only its id and text
are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, text_or_empty
from tessera.llm.license_rules import rules

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

#: Always reported: phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words of keywords that patterns go on with inside a word; they are looked for as substrings.
OPEN = ("licen", "gpl", "mpl", "redistribut", "modif", "scrap", "kommerziell", "gemeinfrei", "copyright", "train", "©")
#: Too common in any prose to tell texts apart.
COMMON = set("all any are by can change copy for have just just more must name names nc nd not only or part sa share text that the this title train under use version what with without you".split())


def gate_words() -> list[str]:
    """Of each keyword without an OPEN part its longest word that isn't common."""
    keywords = {k for _, _, k, _, _ in rules()} | set(BASE)
    closed = [k for k in keywords if not any(w in k for w in OPEN)]
    return sorted({max((w for w in k.split() if w not in COMMON), key=lambda w: (len(w), w)) for k in closed})


def gate(low: Column, words: Column) -> Column:
    """Whether a keyword can stand in the text: one look at each word, and a few substrings."""
    found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, gate_words()))), 0)
    for k, w in enumerate(OPEN):
        found = found.when(F.contains(low, F.lit(w)), k)
    return found.isNotNull()


def sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits() -> str:
    """SQL for the rules that match `padded`, as an array. Patterns are literals, compiled once a task; a keyword is looked for once."""
    by_keyword: dict[str, list[str]] = {}
    for turn, (priority, label, keyword, pattern, confidence) in enumerate(rules()):
        rule = f"named_struct('turn', {turn}, 'priority', {priority}, 'label', {sql(label)}, 'pattern', {sql(pattern)}, 'confidence', {confidence}D)"
        by_keyword.setdefault(keyword, []).append(f"if(padded rlike {sql(f' (?:{pattern}) ')}, {rule}, null)")
    groups = [f"if(contains(padded, {sql(k)}), array({', '.join(r)}), null)" for k, r in by_keyword.items()]
    return f"filter(flatten(filter(array({', '.join(groups)}), g -> g is not null)), r -> r is not null)"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (places), base_labels, found (kept detections folded to labels, best, n)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.translate(text_or_empty(text_col), UPPER, LOWER).alias("low"))
    d = d.withColumn("words", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    padded = F.when(gate(F.col("low"), F.col("words")), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise("")
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), padded.alias("padded"))
    # a match's first word gets a mark; the marked words' numbers are the places
    places = "transform(filter(transform(split(regexp_replace(padded, concat(' (', {p}, ')(?= )'), ' \u0001$1'), ' '), (w, i) -> if(startswith(w, '\u0001'), i - 1, -1)), i -> i >= 0), i -> bigint(i))"
    base = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(x).alias("label")) for p, x in BASE.items()])
    d = d.withColumn("base_hit", F.filter(base, lambda b: F.col("padded").contains(F.concat(F.lit(" "), b["phrase"], F.lit(" ")))))
    d = d.withColumn("base", F.expr(f"flatten(transform(base_hit, b -> {places.format(p='b.phrase')}))"))
    d = d.withColumn("hit", F.expr(f"case when padded <> '' then {hits()} end"))
    # (start, -end, -priority) order: a later one can only be covered by an earlier one
    length = "transform(regexp_extract_all(padded, concat(' (', r.pattern, ')(?= )'), 0), m -> bigint(length(m) - length(replace(m, ' ', ''))))"
    spans = f"flatten(transform(hit, r -> zip_with({places.format(p='r.pattern')}, {length}, (a, k) -> struct(a as start, -(a + k) as back, -r.priority as rank, r.turn as turn, r.label as label, r.confidence as confidence))))"
    d = d.withColumn("spans", F.expr(f"sort_array({spans})"))
    # the furthest end so far by lowest priority that counts: m1 of all, m2 of 2 and 3, m3 of 3
    fold = """aggregate(spans, struct(-1L as m1, -1L as m2, -1L as m3, cast(array() as array<string>) as labels, 0.0D as best, 0L as n), (s, x) ->
      if(-x.back <= case x.rank when -1 then s.m1 when -2 then s.m2 else s.m3 end, s,
        struct(greatest(s.m1, -x.back) as m1, if(x.rank <= -2, greatest(s.m2, -x.back), s.m2) as m2, if(x.rank <= -3, greatest(s.m3, -x.back), s.m3) as m3,
          array_union(s.labels, array(x.label)) as labels, greatest(s.best, double(x.confidence)) as best, s.n + 1 as n)))"""
    return d.select("doc_id", "n_words", "base", F.col("base_hit.label").alias("base_labels"), F.expr(fold).alias("found"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    every = F.array_union("base_labels", F.coalesce("found.labels", none))
    best = F.greatest(F.coalesce("found.best", F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0))
    return scanned(docs, id_col, text_col).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"), joined(every).alias("labels"), best.alias("score"), F.coalesce("found.n", F.lit(0).cast("long")).alias("n_detections"),
    )
