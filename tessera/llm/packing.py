"""Packing token sequences with a grouping genetic algorithm.

Documents become pieces of at most LENGTH tokens; full pieces are sequences of their own. The other
pieces are dealt by hash into problems of about PROBLEM pieces. Each problem is evolved on ISLANDS
islands: a genome is a list of bins; crossover injects the best filled bins of one parent whole into
the other, drops the bins that then hold duplicates and best-fits the displaced pieces, after bins
have swapped pieces for displaced larger ones that fill them better; mutation empties a few of the
poorest bins in the same way. The start is best fit, so the result never needs more bins. Between
epochs the elite of each island moves to the next one. At the end the bins that are not well filled
in their problem are pooled over problems and evolved once more, a thousandth of them at a time.

Edge cases: a null or empty text is its end token alone; equal ids stay rows of their own; a very
long text is tokenized whole and cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, small_batches
from tessera.llm.words import arrow_map, texts

LENGTH = 1024
END = 2
PROBLEM = 4096
ISLANDS = 2
EPOCHS = 2
#: Offspring of an island in an epoch.
BROOD = 8
POPULATION = 5


@lru_cache(1)
def _encoder(vocabulary: str, merges: str):
    """ids(text) as tokenizers gives them for the file `vocabulary`, by tiktoken over the same merges where the two agree."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(merges), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its pattern runs out of stack on very long runs of blanks
                pass
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def pieces_of(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", merges: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """A row per piece: uid, doc_id, piece, start, length, ids_crc32. Of a longer document only the first piece may be shorter than `length`."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        encode = _encoder(vocabulary, merges)
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4")
            first = len(ids) % length or length
            edges = [0, *range(first, len(ids) + 1, length)]
            for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                rows.append((doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    cut = arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, schema, "doc_id long, piece int, start long, length long, ids_crc32 long", 1)
    return cut.select(F.monotonically_increasing_id().alias("uid"), "*")


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts items (longest first) where the least room is left over; opens bins where none has room."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def top_up(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Swaps items of bins for larger loose ones that fit, where the least room is left over; returns what is loose then."""
    free = sorted((sizes[i], i) for i in loose)
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        while room and free:
            best = (0, 0, 0)
            for at, i in enumerate(b):
                k = bisect_right(free, (sizes[i] + room, len(sizes))) - 1
                if k >= 0:
                    best = max(best, (free[k][0] - sizes[i], at, k))
            gain, at, k = best
            if not gain:
                break
            out, b[at] = b[at], free.pop(k)[1]
            insort(free, (sizes[out], out))
            room -= gain
    return [i for _, i in free]


def cross(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Bins of `a`, drawn among its best filled half, go whole into `b`."""
    order = sorted(a, key=lambda x: -sum(sizes[i] for i in x))
    best = order[: max(1, len(order) // 2)]
    child = [list(best[k]) for k in rng.permutation(len(best))[: max(1, len(best) // 2)]]
    have = {i for x in child for i in x}
    displaced = []
    for x in b:
        if have.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in have]
    return best_fit(top_up(child, displaced, sizes, capacity), sizes, child, capacity)


def mutate(a: list[list[int]], gone: int, sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Empties `gone` bins, poorly filled ones rather, and places their items anew."""
    worth = [sum(sizes[i] for i in x) + 0.2 * capacity * rng.random() for x in a]
    order = sorted(range(len(a)), key=worth.__getitem__)
    kept = [list(a[k]) for k in order[gone:]]
    displaced = [i for k in order[:gone] for i in a[k]]
    return best_fit(top_up(kept, displaced, sizes, capacity), sizes, kept, capacity)


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], brood: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """An epoch of an island; the best genome comes first. Stops early at the lower bound of bins."""
    bound = -(-sum(sizes) // capacity)
    scored = lambda p: (fitness(p, sizes, capacity), p)
    if not population:
        population = [best_fit(list(range(len(sizes))), sizes, [], capacity)]
    held = [scored(p) for p in population]
    while len(held) < POPULATION and len(held[0][1]) > bound:
        held.append(scored(mutate(held[0][1], max(2, len(held[0][1]) // 4), sizes, capacity, rng)))
    held.sort(key=lambda x: x[0], reverse=True)
    for _ in range(brood):
        if len(held[0][1]) <= bound:
            break
        a, b = rng.choice(len(held), 2, replace=False)
        child = cross(held[a][1], held[b][1], sizes, capacity, rng)
        child = scored(mutate(child, max(2, len(child) // 20), sizes, capacity, rng))
        if child[0] > held[-1][0]:
            held[-1] = child
            held.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in held]


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(labels: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        out.setdefault(k, []).append(i)
    return list(out.values())


ISLAND_DDL = "problem long, island int, pieces array<long>, sizes array<int>, genomes array<array<int>>, bins int"


def _epoch(islands: DataFrame, capacity: int, brood: int, epoch: int) -> DataFrame:
    schema = pa.schema([("problem", pa.int64()), ("island", pa.int32()), ("pieces", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("genomes", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32())])

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        out = []
        for r in b.to_pylist():
            rng = np.random.default_rng([r["problem"] & 0xFFFFFFFF, r["island"], epoch])
            found = evolve(r["sizes"], capacity, [_bins(g) for g in r["genomes"] or []], brood, rng)
            r["genomes"], r["bins"] = [_labels(g, len(r["sizes"])) for g in found[:2]], len(found[0])
            out.append(r)
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)

    return arrow_map(islands, run, schema, ISLAND_DDL)


def evolved(items: DataFrame, problems: int, capacity: int, islands: int, epochs: int, brood: int) -> DataFrame:
    """items(item, size) -> (item, size, bin string); each of the `problems` holds what its hash gives it."""
    spark = items.sparkSession
    dealt = items.withColumn("problem", F.pmod(F.xxhash64("item"), F.lit(problems)))
    rows = dealt.groupBy("problem").agg(F.sort_array(F.collect_list(F.struct(F.col("size").cast("int").alias("size"), "item"))).alias("all"))
    rows = rows.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("all.item").alias("pieces"), F.col("all.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("genomes"), F.lit(0).alias("bins"))
    tasks = max(1, min(problems * islands, 4 * spark.sparkContext.defaultParallelism if problems * islands < 1000 else problems * islands // 8))
    for epoch in range(epochs):
        if epoch:  # the elite of the island before joins
            elite = rows.select("problem", ((F.col("island") + 1) % islands).alias("island"), F.slice("genomes", 1, 1).alias("elite"))
            rows = rows.join(elite, ["problem", "island"]).withColumn("genomes", F.concat("genomes", "elite")).drop("elite")
        rows = rows.select("problem", "island", "pieces", "sizes", "genomes", "bins").repartition(tasks, "problem", "island")
        rows = save(_epoch(rows, capacity, brood, epoch), "islands")
    best = rows.groupBy("problem").agg(F.min_by(F.struct("pieces", "sizes", F.col("genomes")[0].alias("bin")), F.struct("bins", "island")).alias("best"))
    cells = best.select("problem", F.explode(F.arrays_zip("best.pieces", "best.sizes", "best.bin")).alias("cell"))
    return cells.select(F.col("cell.pieces").alias("item"), F.col("cell.sizes").cast("long").alias("size"), F.concat_ws("-", F.lit(problems), "problem", "cell.bin").alias("bin"))


def pack(docs: DataFrame, length: int = LENGTH, problem: int = PROBLEM, islands: int = ISLANDS, epochs: int = EPOCHS, brood: int = BROOD, **reading) -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    pieces = save(pieces_of(docs, length, **reading), "pieces")
    items = pieces.where(F.col("length") < length).select(F.col("uid").alias("item"), F.col("length").alias("size"))  # a document has at most one such piece
    n = items.count()
    bins = save(evolved(items, -(-n // problem), length, islands, epochs, brood) if n else items.withColumn("bin", F.lit("")), "bins")
    fill = bins.groupBy("bin").agg(F.sum("size").alias("fill"))
    poor = fill.where(F.col("fill") < 0.97 * length).select("bin")
    rest = bins.join(poor, "bin", "left_semi").select("item", "size")
    n_rest = rest.count()
    if n_rest and n > problem:
        again = save(evolved(rest, -(-n_rest // problem), length, islands, epochs, brood).withColumn("bin", F.concat(F.lit("rest-"), "bin")), "bins")
        bins = bins.join(poor, "bin", "left_anti").select("item", "size", "bin").unionByName(again)
    placed = bins.withColumn("offset", F.coalesce(F.sum("size").over(Window.partitionBy("bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.select(F.col("item").alias("uid"), F.min("item").over(Window.partitionBy("bin")).alias("first"), "offset")
    short = pieces.where(F.col("length") < length).join(placed, "uid")
    full = pieces.where(F.col("length") >= length).select("*", F.col("uid").alias("first"), F.lit(0).cast("long").alias("offset"))
    rows = short.unionByName(full)
    # a sequence has the number of its first piece
    return rows.withColumnRenamed("first", "sequence_id").select("uid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row per sequence: sequence_id, tokens, pieces (offset, doc_id, piece, start, length)."""
    packed = pack(docs, id_col=id_col, **options)
    cells = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), cells.alias("pieces"))
