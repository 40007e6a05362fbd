"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts, contexts and probabilities are tables in Spark, sharded by gram, at every order; the driver
sees four counts of counts an order. Training counts the grams of all trusted rows. Texts travel in
groups of about GROUP_BYTES, as compressed blobs: a group asks the model's shards for its distinct
grams, each once, by a join on the gram, and the answers come back to the group's texts. So the join
grows with the distinct grams of groups, not with the texts, and no table is sent to every task.

Trusted ids reach the texts by a join, too; before it a Bloom filter of fixed size on the ids thins
out the texts that move. What it lets pass by chance the join removes: its size changes no result.

A document stays if its perplexity lies within its language's quantiles, widened by SLACK: LOW of all
trusted text, HIGH of a tenth of it, by hash of the id, that the model was not trained on (text of the
training is more predictable). Quantiles are exact on a grid of STEPS steps for each doubling of the
perplexity; so many counts, not the documents, are what one task sorts. A language with fewer than
LEAST texts in that tenth uses all languages' quantiles; with no trusted text at all every document
with a word stays.

Edge cases: null and empty texts have no perplexity and do not stay; a null language is a language of
its own; a null doc_id is scored but never trained on; a very long text is read whole, a window at a
time; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, small_batches
from tessera.llm.words import texts

ORDER = 5
#: A symbol is a byte plus 1, or START; a gram is its symbols in fields of FIELD bits, the last one lowest.
START, FIELD = 257, 9
GROUP_BYTES = 48 << 20
#: Bytes of texts that a task packs at once, and positions whose grams it makes at once.
PACK_BYTES, WINDOW = 32 << 20, 1 << 20
BLOOM_BITS = 26
LOW, HIGH, SLACK, LEAST, STEPS = 0.005, 0.995, 0.1, 30, 1024


def window_grams(data: np.ndarray, starts: np.ndarray, a: int, z: int) -> np.ndarray:
    """The ORDER-grams that end at bytes a to z of texts that lie one after another from `starts` on."""
    back = min(a, ORDER - 1)
    symbols = data[a - back : z].astype(np.int64) + 1
    gram = symbols[back:].copy()
    near = starts[np.searchsorted(starts, a - ORDER) : np.searchsorted(starts, z)]
    for k in range(1, ORDER):
        before = np.full(z - a, START, np.int64)
        known = symbols[max(0, back - k) : max(0, len(symbols) - k)]
        before[z - a - len(known) :] = known
        for j in range(k):  # before a text's start
            at = near + j - a
            at = at[(at >= 0) & (at < z - a)]
            before[at] = START
        gram |= before << (FIELD * k)
    return gram


def byte_data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts; the end comes last."""
    joined = texts(column).cast(pa.large_binary())
    if not len(joined):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = joined.buffers()
    edges = np.frombuffer(buffers[1], np.int64, len(joined) + 1, joined.offset * 8)
    return np.frombuffer(buffers[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def grams_of(column: pa.Array):
    """Windows (a, z, grams) over the texts. A text that starts within a gram of an empty one has its own start."""
    data, edges = byte_data(column)
    starts = np.unique(edges[:-1])
    for a in range(0, len(data), WINDOW):
        z = min(len(data), a + WINDOW)
        yield a, z, window_grams(data, starts, a, z)


def add_counts(held: tuple[np.ndarray, np.ndarray] | None, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams with their counts, with `grams` added."""
    found, n = np.unique(grams, return_counts=True)
    if held is None:
        return found, n
    both, at = np.unique(np.concatenate([held[0], found]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([held[1], n])).astype(np.int64)


def counted(columns) -> tuple[np.ndarray, np.ndarray]:
    held, waiting, size = None, [], 0
    for column in columns:
        for _, _, g in grams_of(column):
            waiting.append(g)
            size += len(g)
            if size > 4 * WINDOW:
                held, waiting, size = add_counts(held, np.concatenate(waiting)), [], 0
    if size:
        held = add_counts(held, np.concatenate(waiting))
    return held or (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bloom_of(ids: DataFrame) -> np.ndarray:
    """2 ** BLOOM_BITS bits, whatever the number of ids; three are set for an id."""
    h = F.xxhash64(ids.columns[0])
    places = F.array(*[F.shiftright(h, k * 19).bitwiseAND((1 << BLOOM_BITS) - 1) for k in range(3)])
    bits = ids.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    out[np.asarray(bits.column(0))] = np.asarray(bits.column(1)).astype(np.uint32)
    return out


def may_hold(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for k in range(3):
        bit = (hashes >> (k * 19)) & ((1 << BLOOM_BITS) - 1)
        out &= (bloom[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
    return out


def in_groups(docs: DataFrame, group: Column, id_col: str, text_col: str, lang_col: str, bloom: np.ndarray | None = None) -> DataFrame:
    """(g, blob): the documents of a group, doc_id, lang and text, in compressed parts."""
    shared = None if bloom is None else docs.sparkSession.sparkContext.broadcast(bloom)
    schema = pa.schema([("g", pa.int64()), ("blob", pa.binary())])

    def pack(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        g = np.asarray(table.column("g"))
        order = np.argsort(g, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(g[order])) + 1).tolist(), len(g)]
        for a, z in zip(edges, edges[1:], strict=False):
            part, sink = table.select(["doc_id", "lang", "text"]).take(pa.array(order[a:z])), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                w.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([g[order[a]]]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if shared is not None:
                b = b.filter(pa.array(may_hold(shared.value, np.asarray(b.column("h")))))
            if len(b):
                held.append(b)
                size += b.nbytes
            if size > PACK_BYTES:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if bloom is not None:
        rows = rows.where("doc_id is not null")
    return rows.select("*", F.xxhash64("doc_id").alias("h"), group.alias("g")).mapInArrow(run, "g long, blob binary")


def unpacked(blobs: pa.ChunkedArray):
    for blob in blobs:
        yield from pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()


def count_grams(docs: DataFrame, ids: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, c over all texts of `docs` whose id is in the first column of `ids`, a distinct one."""
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups))
    blobs = in_groups(docs, group, id_col, text_col, text_col, bloom_of(ids)).repartition(groups, "g")
    asked = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).select("doc_id", group.alias("g"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("doc_id").combine_chunks()
        learn = (b.column(2).filter(pc.is_in(b.column(0), known)) for b in unpacked(left.column("blob")))
        grams, n = counted(learn)
        return pa.table({"key": grams, "c": n})

    found = blobs.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(run, "key long, c long")
    return save(found.groupBy("key").agg(F.sum("c").alias("c")), "grams")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = (max(1, n) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return tuple(np.clip(d, 0.1, [1, 2, 3]).tolist())


def train(counts: DataFrame) -> DataFrame:
    """From counts(key, c) of ORDER-grams the model (key, a, lam): P(gram) = a(gram) + lam(context) * P(gram without
    its first symbol). A missing `a` is 0, a missing `lam` is 1, and below single symbols P is 1 / 256."""
    table, parts = counts, []
    for k in range(ORDER, 0, -1):
        d = discounts(*table.agg(*[F.count_if(F.col("c") == n) for n in (1, 2, 3, 4)]).first())
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        cut = F.least(cut, F.col("c"))
        held = table.withColumn("context", F.shiftright("key", FIELD))
        contexts = held.groupBy("context").agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"))
        parts.append(held.join(contexts, "context").select("key", ((F.col("c") - cut) / F.col("total")).alias("a"), F.lit(None).cast("double").alias("lam")))
        parts.append(contexts.select(F.col("context").alias("key"), F.lit(None).cast("double").alias("a"), (F.col("cut") / F.col("total")).alias("lam")))
        if k > 1:  # a lower order counts in how many contexts a gram is seen
            shorter = F.col("key").bitwiseAND(F.lit((1 << FIELD * (k - 1)) - 1).cast("long"))
            table = save(table.groupBy(shorter.alias("key")).agg(F.count("*").alias("c")), "grams")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return save(every.groupBy("key").agg(F.max("a").cast("float").alias("a"), F.max("lam").cast("float").alias("lam")), "model")


def chain(grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of ORDER-grams, from single symbols up, the grams and contexts that their probability takes."""
    ends = [grams & ((1 << FIELD * k) - 1) for k in range(1, ORDER + 1)]
    return [(g, g >> FIELD) for g in ends]


def perplexities(docs: DataFrame, model: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_bytes, has_word, perplexity (null without text)."""
    small_batches(docs.sparkSession)
    blobs = in_groups(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)), id_col, text_col, lang_col).repartition(groups, "g")

    def distinct(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for g, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = counted(p.column(2) for p in unpacked([blob]))[0]
                held[g] = np.union1d(held[g], found) if g in held else found
        for g, grams in held.items():
            keys = np.unique(np.concatenate([x for pair in chain(grams) for x in map(np.unique, pair)]))
            for a in range(0, len(keys), 1 << 18):
                part = keys[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), g)), pa.array(part)], names=["g", "key"])

    answers = blobs.mapInArrow(distinct, "g long, key long").join(model, "key", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("has_word", pa.bool_()), ("perplexity", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(right.column("key")))
        keys = np.asarray(right.column("key"))[order]
        a = np.asarray(pc.fill_null(right.column("a"), 0.0), np.float64)[order]
        lam = np.asarray(pc.fill_null(right.column("lam"), 1.0), np.float64)[order]
        longest = keys[keys >> (FIELD * (ORDER - 1)) > 0]
        p = np.full(len(longest), 1 / 256)
        for gram, context in chain(longest):
            p = a[np.searchsorted(keys, gram)] + lam[np.searchsorted(keys, context)] * p
        logs, place = np.log(p), pd.Index(longest)
        out = []
        for b in unpacked(left.column("blob")):
            data, edges = byte_data(b.column(2))
            total, words = np.zeros(len(b)), np.zeros(len(b), np.int64)
            for s, z, grams in grams_of(b.column(2)):
                sums = np.concatenate([[0.0], np.cumsum(logs[place.get_indexer(grams)])])
                full = np.concatenate([[0], np.cumsum((data[s:z] != 32) & ((data[s:z] < 9) | (data[s:z] > 13)))])
                low, high = np.clip(edges[:-1], s, z) - s, np.clip(edges[1:], s, z) - s
                total += sums[high] - sums[low]
                words += full[high] - full[low]
            n = np.diff(edges)
            perplexity = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
            out.append(pa.record_batch([b.column(0), b.column(1), pa.array(n), pa.array(words > 0), perplexity], schema=schema))
        return pa.Table.from_batches(out, schema)

    return blobs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, "doc_id long, lang string, n_bytes long, has_word boolean, perplexity double")


def bounds(trusted: DataFrame, by: list[str]) -> DataFrame:
    """Of trusted(lang, perplexity, fresh), for each value of `by`: n (fresh ones), low (quantile of all) and high (of fresh ones), on the grid."""
    step = F.floor(F.log2("perplexity") * STEPS).alias("step")
    steps = trusted.groupBy(*by, step).agg(F.count("*").alias("every"), F.count_if("fresh").alias("fresh"))
    group = Window.partitionBy(*by or [F.lit(0)])
    for c in ("every", "fresh"):
        steps = steps.withColumn(f"{c}_upto", F.sum(c).over(group.orderBy("step"))).withColumn(f"{c}_all", F.sum(c).over(group))
    at = lambda c, q: F.min(F.when(F.col(f"{c}_upto") >= F.greatest(F.lit(1), F.ceil(F.col(f"{c}_all") * q)), F.col("step")))
    return steps.groupBy(*by).agg(F.max("fresh_all").alias("n"), F.pow(2.0, at("every", LOW) / STEPS).alias("low"), F.pow(2.0, (at("fresh", HIGH) + 1) / STEPS).alias("high"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, low, high, kept."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))
    trusted = save(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct(), "trusted")
    tenth = F.pmod(F.xxhash64("good_id"), F.lit(10)) == 0
    model = train(count_grams(docs, trusted.where(~tenth), groups, id_col, text_col))
    scored = save(perplexities(docs, model, groups, id_col, text_col, lang_col), "scored")
    known = trusted.select("good_id", tenth.alias("fresh"))
    held = scored.where("perplexity is not null").join(known, F.col("doc_id") == F.col("good_id"))
    held = save(held.select("lang", "perplexity", "fresh"), "held")
    overall = bounds(held, []).first()
    by_lang = bounds(held, ["lang"]).where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), "low", "high")
    least = (1 - SLACK) * F.coalesce("low", F.lit(overall["low"] if overall else None).cast("double"), F.lit(0.0))
    most = (1 + SLACK) * F.coalesce("high", F.lit(overall["high"] if overall else None).cast("double"), F.lit(float("inf")))
    kept = F.coalesce(F.col("has_word") & F.col("perplexity").between(least, most), F.lit(False))
    return scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").select("doc_id", "lang", "n_bytes", "perplexity", least.alias("low"), most.alias("high"), kept.alias("kept"))
