"""Quality rules as a ledger of failure bits. DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one long with a bit
for each failed rule. Policies are named, versioned bit masks: applying one is a bitwise `and`, and
ablations (what a policy would keep without one of its rules) come from counts of masked bits.

Edge cases: a null or empty text has no words, zero measurements and fails the base rule; ties and
repeated rows are rows of their own; a very long text is read whole; an empty table gives no rows and
ablations over zero documents; of a document only its id and its text are read, so that other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: name -> failure, over the measurements. The order is the order of the bits: only ever append.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * n_upper > word_chars",
    "many_words": "n_words > 100000",
}
BASE = ("few_words", "repeated_windows")


def mask(*names: str) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


#: version -> rules that reject.
POLICIES: dict[str, int] = {
    "base": mask(*BASE),
    "v1": mask(*BASE, "word_length", "symbols"),
    "v2": mask(*BASE, "word_length", "symbols", "duplicate_lines", "shouting"),
}
CURRENT = "v2"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each document, all long."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id",
        "words",
        F.size("words").alias("n"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    # windows of 3 words by hash; the words of those alone whose hash comes again are compared
    d = d.withColumn("windows", F.expr("case when n >= 3 then transform(sequence(0, n - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) else array() end"))
    d = d.withColumn("hashes", F.expr("case when size(array_distinct(windows)) < size(windows) then sort_array(transform(windows, (h, i) -> struct(h, i))) else array() end")).drop("windows")
    d = d.withColumn("again", F.expr("transform(filter(hashes, (x, k) -> (k > 0 and x.h = hashes[greatest(k - 1, 0)].h) or x.h = get(hashes, k + 1).h), x -> x.i)")).drop("hashes")
    # a word holds no blank, so that a joined window stands for one triple; a tab parts it from its place and sorts all of one window side by side
    d = d.withColumn("sorted", F.expr("sort_array(transform(again, i -> concat(words[i], ' ', words[i + 1], ' ', words[i + 2], '\t', i)))")).drop("words", "again")
    d = d.withColumn("keys", F.expr("transform(sorted, x -> substring_index(x, '\t', 1))"))
    d = d.withColumn("twice", F.expr("filter(transform(sorted, (x, k) -> case when (k > 0 and keys[k] = keys[greatest(k - 1, 0)]) or keys[k] = get(keys, k + 1) then int(substring_index(x, '\t', -1)) end), p -> p is not null)"))
    repeat = F.expr("size(array_distinct(flatten(transform(twice, p -> array(p, p + 1, p + 2)))))")
    columns = ["word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), *[F.col(c).cast("long").alias(c) for c in columns], repeat.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `failures`: bit i is set where rule i of RULES fails."""
    bits = F.lit(0).cast("long")
    for i, failure in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failure), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, id_col, text_col).withColumn("failures", bits)


def passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept."""
    return rows.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that it alone rejects, and that stay without it."""
    held = POLICIES[policy]
    tally = rows.groupBy(F.col("failures").bitwiseAND(F.lit(held).cast("long")).alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    names = [(i, n) for i, n in enumerate(RULES) if held >> i & 1]
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in names])
    each = tally.select("bits", "n", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def quality(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = apply_policy(ledger(docs, id_col, text_col), policy)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "failures")
