"""Near-duplicates by one-permutation hashing with optimal densification.

Documents with equal shingle sets collapse to a class first. Each class has one signature: its
shingles' hashes fall into BINS bins by their top bits and the least of a bin counts; an empty bin
takes the value of a full bin that a fixed sequence of random draws finds. BANDS bands of ROWS bins
make bucket keys. A bucket links its members to its smallest one: a star, so that a bucket of n
members has n - 1 candidate edges. Edges are confirmed on the full shingle sets.

A star alone can lose a link between two members that both differ from its centre. So the members
of buckets that still lie in several components are joined once more, exactly, by prefix filters.

Of a pair at similarity 0.8 the bands miss 6e-6.

Edge cases: a null or wordless text has an empty set and no links; a single word is one shingle; a
very long text is one set like others, never cut; a null doc_id takes part and has the least doc_id
of its component, null if there is none; rows that share a doc_id are rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep_keys, save, small_batches
from tessera.llm.words import arrow_map, mix, split_words, word_hashes, word_ids

BIN_BITS = 8
BINS = 1 << BIN_BITS
BANDS, ROWS = 42, 6
#: Keys that hold more than one HOT_KEYS-th of all rows are split into SALTS parts.
HOT_KEYS, SALTS = 4096, 64
#: Ratio of the sizes in one class of the prefix filter.
SIZE_STEP = "1.06D"
#: Draws of the densification: DRAWS[t, b] is the bin that empty bin b tries at its t-th draw.
DRAWS = np.random.default_rng(20).integers(0, BINS, (4096, BINS), dtype=np.int64)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `width` words; with fewer words, of them all."""
    flat, counts = split_words(column)
    ids, distinct = word_ids(flat)
    words = word_hashes(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)
    grams = words.copy()
    for k in range(1, width):
        grams = mix(grams + np.uint64(0x9E3779B97F4A7C15))
        grams[: len(words) - k] += words[k:]
    grams = mix(grams)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            short = np.array([n], np.uint64)  # a marker of the length keeps short texts apart from shingles
            for k in range(at, at + n):
                short = mix(short) + words[k : k + 1]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS values of a sorted, non-empty set."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
    first = np.searchsorted(hashes, edges)
    least = hashes[np.minimum(first, len(hashes) - 1)]
    full = (first < len(hashes)) & (least >> np.uint64(64 - BIN_BITS) == np.arange(BINS, dtype=np.uint64))
    source = np.arange(BINS)
    if not full.all():
        empty = np.flatnonzero(~full)
        for draw in DRAWS:
            to = draw[empty]
            hit = full[to]
            source[empty[hit]] = to[hit]
            empty = empty[~hit]
            if not len(empty):
                break
        else:
            source[empty] = np.flatnonzero(full)[0]
    return least[source]


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key ^ rows[:, k]) + np.uint64(k)
    return mix(key)


def _as_set(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def row_hash(id_col: str, text_col: str) -> Column:
    """Of id and text, so that copies of a text spread over tasks."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, text_hash (of id and text), n_shingles, whole (128 bits of the set; null if it is empty), bands."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("whole", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        sets = shingle_sets(b.column(1), width)
        keys = [band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(b))), b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_as_set(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    columns = docs.select(F.col(id_col).cast("long"), text_col, row_hash(id_col, text_col))
    return arrow_map(columns, run, schema, "uid long, doc_id long, text_hash long, n_shingles long, whole binary, bands array<long>", 1)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, root) with the smallest node of each component, by alternating large and small stars.

    `edges`: (a, b), written tables. Every round at least halves the depth of what is left.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = save(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = save(small.union(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
        sign = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if sign == last:
            break
        last = sign
    found = edges.select(F.col("a").alias(node), F.col("b").alias("root"))
    return nodes.join(found, node, "left").select(node, F.coalesce("root", node).alias("root"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar: 100 * intersection >= percent * union."""
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    n, m = F.size("set_a"), F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * both >= percent * (n + m - both))
    return pairs.join(right, "b").join(left, "a").where(near).select("a", "b")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """From sets(rep, root, shingles), candidates (a, b) of different roots, every similar pair among them.

    Exact: with all shingles in one order, rare ones first, two similar sets share one in their first
    few. How many depends on both sizes, so sizes fall into classes and a set has a prefix for each
    class it can be similar to. Where a shingle's sets have a root in common, only the others are paired.
    """
    need = lambda n, m: f"cast(ceil({percent} * ({n} + {m}) / {100 + percent}) as int)"
    cls = lambda n: f"cast(floor(ln({n}) / ln({SIZE_STEP})) as int)"
    each = sets.select("rep", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rarity = each.groupBy("shingle").agg(F.count("*").alias("df"))
    ordered = each.join(rarity, "shingle").groupBy("rep", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    ordered = ordered.withColumn("cls", F.expr(cls("n")))
    ordered = ordered.withColumn("other", F.explode(F.expr(f"sequence({cls(f'ceil({percent} * n / 100)')}, {cls(f'floor(n * 100 / {percent})')})")))
    ordered = ordered.withColumn("least", F.expr(f"greatest(cast(floor(pow({SIZE_STEP}, other)) as int) - 1, cast(ceil({percent} * n / 100) as int))"))
    prefix = F.slice("order", F.lit(1), F.expr(f"greatest(n - {need('n', 'least')} + 1, 0)"))
    # the shared shingle before: a pair that has it in common too is found there, so each pair comes from its first
    cells = F.expr("transform(head, (c, i) -> struct(c.df as df, c.shingle as shingle, case when i > 0 and head[greatest(i - 1, 0)].df > 1 then head[greatest(i - 1, 0)].shingle end as before))")
    heads = ordered.withColumn("head", prefix).select("rep", "root", "n", "cls", "other", F.posexplode(cells).alias("place", "cell")).where("cell.df > 1")
    heads = heads.select("rep", "root", "n", "cls", "other", (F.col("place") + 1).alias("place"), F.col("cell.before").alias("before"), F.col("cell.shingle").alias("shingle"), F.least("cls", "other").alias("low"), F.greatest("cls", "other").alias("high"))
    key = ["shingle", "low", "high"]
    tally = heads.groupBy(*key, "root").agg(F.count("*").alias("n_root"))
    mains = tally.groupBy(*key).agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    open_ = heads.join(mains, key)
    left = open_.where("root <> main").select(*key, *[F.col(c).alias(f"{c}_a") for c in ("rep", "root", "n", "cls", "other", "place", "before")])
    right = open_.select(*key, "main", *[F.col(c).alias(f"{c}_b") for c in ("rep", "root", "n", "cls", "other", "place", "before")])
    pairs = left.join(right, key).where(
        "root_a <> root_b and not coalesce(before_a = before_b, false) and cls_a = other_b and other_a = cls_b and (root_b = main or rep_a < rep_b)"
        f" and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and 1 + least(n_a - place_a, n_b - place_b) >= {need('n_a', 'n_b')}"
    )
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_groups(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: uid, doc_id, text_hash, n_shingles, root (of the component), component_id, kept (doc_id is the component's)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = save(signed(docs, width, id_col, text_col), "signed")
    classes = save(rows.where("whole is not null").groupBy("whole").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = rows.join(classes.select(F.col("rep").alias("uid")), "uid")
    banded = reps.select(F.col("uid").alias("rep"), F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("rep").alias("center"), F.count("*").alias("members")).where("members > 1")
    members = spread_join(banded, shared, ["band", "key"], "members", classes.count() * BANDS, "rep")
    members = save(members.select("band", "key", "center", "rep", "members"), "members")

    pairs = save(members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    taking = members.select("rep").distinct()
    sets = _sets_of(docs, rows, taking, width, text_col, id_col)
    links = save(confirmed(pairs, sets, percent), "links")
    nodes = save(taking.select(F.col("rep").alias("node")), "nodes")
    roots = save(components(nodes, links), "roots")

    placed = members.where("members > 2").join(roots.select(F.col("node").alias("rep"), "root"), "rep")
    open_ = placed.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band", "key")
    unsettled = save(placed.join(open_, ["band", "key"]).select("rep", "root").distinct(), "unsettled")
    fresh = save(prefix_pairs(unsettled.join(sets, "rep"), percent), "pairs")
    found = save(confirmed(fresh, sets, percent), "links")
    if not found.isEmpty():
        roots = save(components(nodes, links.union(found)), "roots")

    of_class = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("whole", F.coalesce("root", "rep").alias("root"), "copies")
    shown, total = ["uid", "doc_id", "text_hash", "n_shingles", "root"], rows.count()
    worded = spread_join(rows.where("whole is not null"), of_class, ["whole"], "copies", total, "uid")
    rooted = save(worded.select(shown).unionAll(rows.where("whole is null").withColumn("root", F.col("uid")).select(shown)), "rooted")  # without words a row is its own root
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies"))
    joined = spread_join(rooted, least, ["root"], "copies", total, "uid")
    return joined.select("uid", "doc_id", "text_hash", "n_shingles", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, by: str) -> DataFrame:
    """rows joined with groups(keys, size, ...), one row a key, where `size` counts a key's rows and `total` all rows.

    A key with more than a HOT_KEYS-th of all rows is dealt to SALTS tasks. Fewer than HOT_KEYS can have so many: they are broadcast."""
    many = total // HOT_KEYS
    hot = groups.where(F.col(size) > many).select(*keys, F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0))).drop("hot")
    salts = F.sequence(F.lit(0), F.when(F.col(size) > many, SALTS - 1).otherwise(0)).cast("array<long>")
    return dealt.join(groups.withColumn("salt", F.explode(salts)), [*keys, "salt"])


def _sets_of(docs: DataFrame, rows: DataFrame, taking: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """(rep, shingles) of the classes that take part in a bucket. One text of each is found by the hash of its row, read and cut again."""
    want = rows.join(taking.withColumnRenamed("rep", "uid"), "uid").select(F.col("uid").alias("rep"), "text_hash", "whole")
    texts = docs.select(F.col(text_col).alias("text"), row_hash(id_col, text_col).alias("text_hash")).join(want, "text_hash")
    texts = texts.dropDuplicates(["text_hash", "rep", "text"])  # repeated rows are in one task already
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        sets = shingle_sets(b.column(1), width)
        mine = [_as_set(s) == w for s, w in zip(sets, b.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema).filter(pa.array(mine))

    return save(arrow_map(texts.select("rep", "text", "whole"), run, schema, "rep long, shingles array<long>", 1), "sets")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` of which exactly one of each component stays, with all their columns; without words a row is a component.

    A row is found again by its doc_id and text together; rows that repeat both are one."""
    able = near_groups(docs, width, percent, id_col, text_col).where("kept")  # one row a component, but for repeated ids
    first = able.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), "uid").alias("first"))
    kept = first.select(_key(F.col("first.doc_id"), F.col("first.text_hash")).alias("key")).distinct()
    return keep_keys(docs, _key(F.col(id_col).cast("long"), row_hash(id_col, text_col)), kept)


def _key(doc_id: Column, text_hash: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_hash.cast("string"))
