"""Scoring texts with a log-bilinear model trained by noise-contrastive estimation.

Counting covers the whole training corpus: token counts are summed in Spark. A word counted at least
LEAST times with at least one SHARE-th of all tokens has a vector of its own, and about VOCABULARY most
frequent ones in any case: at most SHARE words, whatever the corpus. All other words fall by hash
into HASHED classes, each with a vector, so that every token reaches the model as target and as
context. The model predicts a class from the CONTEXT classes before it: their vectors, turned by a
matrix for each place, are added. Classes lie in bins of neighbours by frequency; a class has the
probability of its bin times its own among the bin's classes, both softmaxes of that vector. Training
runs in rounds. In a round every task starts from the same parameters, goes through its part of that
round's documents with noise-contrastive estimation of classes and bins in numpy, and each row of the
parameters is averaged by how often the tasks used it, in Spark; the rounds together see each
training token once. As with any such averaging, the parameters depend on how documents lie in tasks.

Bins and bins' classes are few, so that both normalisers are exact and token probabilities sum to one.
A word of a hashed class has the class's probability times its smoothed share of the class, with one
share for all words that training never saw. The parameters (84 bytes a class) and the counts of words
with one KNOWN-th of all tokens, so at most KNOWN words, travel with the tasks; all other words' counts,
which grow with the corpus, are joined by word.

Edge cases: a null or empty text is its end token alone; a null doc_id counts as held out; a very
long text is scored whole; repeated rows are rows of their own; an empty table gives no rows, and
without training rows the model is nearly uniform; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import save, small_batches
from tessera.llm.words import arrow_map, split_words

VOCABULARY = 1024
LEAST, SHARE, HASHED = 5, 1 << 17, 1 << 12
#: Words with at least one KNOWN-th of all tokens have their counts at hand in every task.
KNOWN = 1 << 20
#: A bin has BIN_LEAST classes, or its first class's number divided by BIN_GROWTH.
BIN_LEAST, BIN_GROWTH = 32, 32
DIMENSION = 20
CONTEXT = 2
NOISE = 32
ROUNDS = 4
CHUNK = 1 << 11
RATE = 0.03
END = 0
#: Tokens whose counts a task adds up before it hands them on.
HELD_TOKENS = 6_000_000
#: Tokens that a task shuffles, rows of parameters in one message, contexts scored at once.
HELD_TRAINING, BLOCK, SLICE = 1 << 20, 1 << 13, 1 << 12
SMOOTH = 0.1


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts; the end tokens are not among them."""
    schema = pa.schema([("word", pa.large_string()), ("n", pa.int64())])

    def run(batches):
        held, size = [], 0

        def flush():
            counts = pa.chunked_array(held, pa.large_string()).value_counts()
            return pa.table({"word": counts.field(0), "n": counts.field(1)}).cast(schema).to_batches(max_chunksize=100_000)

        for b in batches:
            flat, _ = split_words(b.column(0))
            held.append(flat)
            size += len(flat)
            if size > HELD_TOKENS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words, most frequent first, and their counts; the first `own` have vectors. Of each hashed class the count of its words and how many there are."""

    def __init__(self, words: pa.Array, counts: np.ndarray, own: int, hashed: np.ndarray, hashed_types: np.ndarray) -> None:
        self.words, self.counts, self.own = words.cast(pa.large_string()), counts, own
        self.hashed, self.hashed_types = hashed, hashed_types

    def unigram(self, texts: int) -> np.ndarray:
        """Shares of the classes: the end, words with vectors, hashed classes."""
        n = np.concatenate([[texts], self.counts[: self.own], self.hashed]) + 0.5
        return n / n.sum()

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its class and log10 of its smoothed count; of each hashed class log10 of its smoothed size."""
        classes = np.concatenate([np.arange(1, self.own + 1), 1 + self.own + hashed_class(self.words[self.own :])])
        return classes, np.log10(self.counts + SMOOTH), np.log10(self.hashed + SMOOTH * (self.hashed_types + 1))


def hashed_class(words: pa.Array) -> np.ndarray:
    """As pmod(xxhash64(word), HASHED) in Spark."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, 42) % HASHED for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, n_known and logs of the vocabulary, log_hashed (of hashed classes' sizes, less the known
    counts in them), classes (32-bit, with the end), rare words and how often each."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_all", pa.float64()), ("log_hashed", pa.float64()), ("classes", pa.binary()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.own, *vocabulary.tables()))

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        words, own, classes, log_c, log_h = shared.value
        flat, n = split_words(b.column(1))
        d = flat.dictionary_encode()
        size = max(1, len(d.dictionary))
        found = pc.index_in(d.dictionary, words)
        known = np.asarray(found.is_valid())
        place = np.asarray(pc.fill_null(found, 0), np.int64)
        of_word, log_word = np.zeros(len(known), np.int64), np.zeros(len(known))
        of_word[known], log_word[known] = classes[place[known]], log_c[place[known]]
        of_word[~known] = 1 + own + hashed_class(d.dictionary.filter(pa.array(~known)))
        log_class = np.where(of_word > own, log_h[np.maximum(of_word - 1 - own, 0)] - log_word, 0.0)
        ids = np.asarray(d.indices, np.int64)
        owner = np.repeat(np.arange(len(b)), n)
        sums = [np.bincount(owner, w[ids], len(b)) for w in (known, log_word, log_class)]
        cls = of_word[ids].astype("<i4")
        starts = np.concatenate([[0], np.cumsum(n)])
        blobs = [np.append(cls[a:z], np.int32(END)).astype("<i4").tobytes() for a, z in zip(starts, starts[1:], strict=False)]
        # rare words of a document, each once
        at = np.flatnonzero(~known[ids])
        pair, times = np.unique(owner[at] * np.int64(size) + ids[at], return_counts=True)
        place = np.concatenate([[0], np.cumsum(np.bincount(pair // size, minlength=len(b)))])
        names = d.dictionary.take(pa.array(pair % size)).cast(pa.string())
        rare = pa.ListArray.from_arrays(pa.array(place, pa.int32()), names)
        often = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(times, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(b))), b.column(0), pa.array(n + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(blobs, pa.binary()), rare, often], schema=schema)

    ddl = "uid long, doc_id long, n_tokens long, n_known long, log_all double, log_hashed double, classes binary, rare array<string>, times array<int>"
    coded = arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, schema, ddl, 1)
    return coded.withColumn("held_out", held_out("doc_id")).withColumn("round", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(ROUNDS)))


def bin_edges(size: int) -> np.ndarray:
    """Where the bins of `size` classes start, and `size` at the end."""
    edges = [0]
    while edges[-1] < size:
        edges.append(min(size, edges[-1] + max(BIN_LEAST, edges[-1] // BIN_GROWTH)))
    return np.array(edges)


class Parameters:
    """One row for each class, each bin and each line of the context's matrices; the last column has the biases."""

    def __init__(self, unigram: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.edges = bin_edges(len(unigram))
        n, c = len(unigram), len(self.edges) - 1
        self.bin_of = np.repeat(np.arange(c, dtype=np.int32), np.diff(self.edges))
        self.share = np.concatenate([unigram, np.add.reduceat(unigram, self.edges[:-1])])
        if rows is None:
            rows = np.zeros((n + c + CONTEXT * DIMENSION, DIMENSION + 1), np.float32)
            rows[: n + c, :DIMENSION] = np.random.default_rng(1).normal(0, 0.1, (n + c, DIMENSION))
            rows[: n + c, DIMENSION] = np.log(self.share)
            rows[n + c :, :DIMENSION] = np.tile(np.eye(DIMENSION) * 0.5, (CONTEXT, 1))
        self.rows = rows
        self.vectors, self.bias = rows[:n, :DIMENSION], rows[:n, DIMENSION]
        self.bin_vectors, self.bin_bias = rows[n : n + c, :DIMENSION], rows[n : n + c, DIMENSION]
        self.places = rows[n + c :, :DIMENSION].reshape(CONTEXT, DIMENSION, DIMENSION)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For few words, with all of them in one bin. log10 parts: (near context, word), (far context, word), word, and the normaliser of (far, near)."""
        near = (self.vectors @ self.places[0]) @ self.vectors.T
        far = (self.vectors @ self.places[1]) @ self.vectors.T
        a, b = near + self.bias, far
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.exp(b - top_b) @ np.exp(a - top_a).T) + top_b + top_a.T
        scale = np.log10(np.e)
        return tuple((x * scale).astype(np.float32) for x in (near, far, self.bias, z))

    def logs(self, w: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """log10 of each class's probability after its context: its bin's, and its own in the bin."""
        n = len(self.vectors)
        classes, bins = self.rows[:n], self.rows[n : n + len(self.bin_vectors)]
        q = np.ones((len(w), DIMENSION + 1), np.float32)  # the last column meets the biases
        at_near, at_far = self.vectors @ self.places[0], self.vectors @ self.places[1]
        q[:, :DIMENSION] = at_near[near] + at_far[far]
        bin_of = self.bin_of[w]
        out = np.einsum("ij,ij->i", q, bins[bin_of] + classes[w])
        for a in range(0, len(w), SLICE):
            out[a : a + SLICE] -= normaliser(q[a : a + SLICE], bins)
        order = np.argsort(bin_of.astype(np.uint16) if len(bins) < 1 << 16 else bin_of, kind="stable")
        stops = np.searchsorted(bin_of[order], np.arange(len(self.edges)))
        for k in np.flatnonzero(np.diff(stops)):
            words = classes[self.edges[k] : self.edges[k + 1]]
            for a in range(stops[k], stops[k + 1], SLICE):
                some = order[a : min(a + SLICE, stops[k + 1])]
                out[some] -= normaliser(q[some], words)
        return out * np.log10(np.e)


def normaliser(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log of the sum of exp(q . row) over the rows."""
    x, ones = q @ rows.T, np.ones(len(rows), np.float32)
    if x.max(initial=0) < 60:
        z = np.exp(x) @ ones
        if z.min(initial=1) > 1e-20:
            return np.log(z)
    top = x.max(1)  # where exp leaves its range
    x -= top[:, None]
    return np.log(np.exp(x, out=x) @ ones) + top


def contexts(blobs: list[bytes], kind: str = "<i2") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the one before, the one before that, and words per text. Before a text stand ends."""
    w = np.frombuffer(b"".join(blobs), kind).astype(np.int64)
    n = np.array([len(x) // np.dtype(kind).itemsize for x in blobs], np.int64)
    starts = np.cumsum(n) - n
    near, far = np.empty_like(w), np.empty_like(w)
    near[1:], far[2:] = w[:-1], w[:-2]
    near[starts], far[starts] = END, END
    second = starts[n > 1] + 1
    far[second] = END
    return w, near, far, n


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)); overwrites x."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def nce(p: Parameters, squares: np.ndarray, used: np.ndarray, w: np.ndarray, near: np.ndarray, far: np.ndarray, drawn: list[np.ndarray], log_noise: np.ndarray) -> None:
    """One step on tokens that follow each other; the `drawn` noise classes and noise bins serve all of them. Only the rows that take part change."""
    n, c, t = len(p.vectors), len(p.bin_vectors), len(w)
    outputs = p.rows[: n + c]
    va, vb = p.vectors[near], p.vectors[far]
    q = va @ p.places[0] + vb @ p.places[1]
    dq = np.zeros_like(q)
    grads = []
    for target, noise in zip((w, n + p.bin_of[w]), drawn, strict=True):
        right, wrong = outputs[target], outputs[noise]
        vw, vn = right[:, :DIMENSION], wrong[:, :DIMENSION]
        up = logistic(log_noise[target] - right[:, DIMENSION] - np.einsum("ij,ij->i", q, vw))
        down = q @ vn.T
        down += wrong[:, DIMENSION] - log_noise[noise]
        down = logistic(down)
        dq += up[:, None] * vw - down @ vn
        grads.append((up, -(down.T @ q), -down.sum(0)))

    def change(at: np.ndarray, g: np.ndarray) -> None:
        order = np.argsort(at.astype(np.uint16) if n + c < 1 << 16 else at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g, ids = np.add.reduceat(g[order], starts, axis=0), at[starts]
        used[ids] += np.diff(np.append(starts, len(at)))
        squares[ids] += g * g
        p.rows[ids] += RATE * g / np.sqrt(squares[ids])

    def with_noise(at: np.ndarray, g: np.ndarray, noise: np.ndarray, part: tuple) -> None:
        change(np.concatenate([at, noise]), np.concatenate([g, np.hstack([part[1], part[2][:, None]])]))

    # a token is a target, the context of the next one and of the one after that: one line for all three.
    # Before the first token stand its own context; the last line is the end before texts, where that isn't the token two back
    at = np.concatenate([far[:1], near[:1], w, [END]])
    g = np.zeros((t + 3, DIMENSION + 1), np.float32)
    g[2 : t + 2, :DIMENSION], g[2 : t + 2, DIMENSION] = grads[0][0][:, None] * q, grads[0][0]
    g[1 : t + 1, :DIMENSION] += dq @ p.places[0].T
    back = dq @ p.places[1].T
    other = far != at[:t]
    g[t + 2, :DIMENSION] = back[other].sum(0)
    back[other] = 0
    g[:t, :DIMENSION] += back
    places = np.hstack([np.concatenate([va.T @ dq, vb.T @ dq]), np.zeros((CONTEXT * DIMENSION, 1), np.float32)])
    with_noise(at, g, drawn[0], grads[0])
    with_noise(n + p.bin_of[w], np.hstack([grads[1][0][:, None] * q, grads[1][0][:, None]]), drawn[1], grads[1])
    lines = slice(n + c, len(p.rows))
    used[lines] += t
    squares[lines] += places * places
    p.rows[lines] += RATE * places / np.sqrt(squares[lines])


def train_round(coded: DataFrame, start: np.ndarray, unigram: np.ndarray, number: int) -> np.ndarray:
    """The parameters that the tasks reach from `start` on the round's documents, each row averaged by its uses."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((start, unigram))
    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("used", pa.binary()), ("rows", pa.binary())])

    def run(batches):
        start, unigram = shared.value
        p = Parameters(unigram, start.copy())
        squares, used, rng = np.ones_like(p.rows), np.zeros(len(p.rows)), np.random.default_rng(number)
        log_noise = np.log(NOISE * p.share).astype(np.float32)
        n = len(p.vectors)
        sums = [np.cumsum(p.share[:n]), np.cumsum(p.share[n:])]

        def learn(held):
            w, near, far = (np.concatenate(x) for x in zip(*held, strict=True))
            for a in rng.permutation(np.arange(0, len(w), CHUNK)):
                t = slice(a, a + CHUNK)
                drawn = [first + np.minimum(np.searchsorted(s, rng.random(NOISE) * s[-1], "right"), len(s) - 1) for first, s in zip((0, n), sums, strict=True)]
                nce(p, squares, used, w[t], near[t], far[t], drawn, log_noise)

        held, size = [], 0
        for b in batches:
            held.append(tuple(x.astype(np.int32) for x in contexts(b.column(0).to_pylist(), "<i4")[:3]))
            size += len(held[-1][0])
            if size > HELD_TRAINING:
                learn(held)
                held, size = [], 0
        if size:
            learn(held)
        ids = np.flatnonzero(used)
        for k in np.unique(ids // BLOCK):
            some = ids[ids // BLOCK == k]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([some.tobytes()]), pa.array([used[some].tobytes()]), pa.array([p.rows[some].tobytes()])], schema=schema)

    def merge(batches):
        found = {}
        for b in batches:
            for k, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, used, rows = np.frombuffer(x[0], np.int64) - k * BLOCK, np.frombuffer(x[1]), np.frombuffer(x[2], np.float32).reshape(-1, DIMENSION + 1)
                total, sums = found.setdefault(k, (np.zeros(BLOCK), np.zeros((BLOCK, DIMENSION + 1))))
                total[ids] += used
                sums[ids] += used[:, None] * rows
        for k, (total, sums) in found.items():
            at = np.flatnonzero(total)
            rows = (sums[at] / total[at, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([(at + k * BLOCK).tobytes()]), pa.array([rows.tobytes()])], names=["ids", "rows"])

    # as many tasks as cores: each hands on all rows that it used
    part = coded.where((F.col("round") == number) & ~F.col("held_out")).select("classes").coalesce(spark.sparkContext.defaultParallelism)
    parts = part.mapInArrow(run, "block int, ids binary, used binary, rows binary")
    reached = parts.repartition(len(start) // BLOCK + 1, "block").mapInArrow(merge, "ids binary, rows binary").toArrow()
    out = start.copy()
    for ids, rows in zip(*(c.to_pylist() for c in reached.columns), strict=True):
        out[np.frombuffer(ids, np.int64)] = np.frombuffer(rows, np.float32).reshape(-1, DIMENSION + 1)
    shared.destroy()
    return out


def vocabulary_of(counts: DataFrame, total: int) -> Vocabulary:
    """From counts(word, n), whose sum is `total`."""
    own = max(LEAST, -(-total // SHARE))
    top = counts.where(F.col("n") >= max(LEAST, -(-total // KNOWN))).toArrow()
    if len(top) < VOCABULARY - 1:
        top = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - 1).toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    words, named = top.column(0).combine_chunks() if len(top) else pa.array([], pa.string()), np.asarray(top.column(1), np.float64)
    vectors = min(len(named), max(VOCABULARY - 1, int((named >= own).sum())))
    # what is left of each hashed class without the words that have vectors
    by_class = counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(HASHED)).alias("k")).agg(F.sum("n"), F.count("*")).toArrow()
    hashed, types = np.zeros(HASHED), np.zeros(HASHED)
    at = np.asarray(by_class.column(0), np.int64)
    hashed[at], types[at] = np.asarray(by_class.column(1), np.float64), np.asarray(by_class.column(2), np.float64)
    mine = hashed_class(words[:vectors])
    return Vocabulary(words, named, vectors, hashed - np.bincount(mine, named[:vectors], HASHED), types - np.bincount(mine, minlength=HASHED))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    learning = docs.where(~held_out(id_col))
    counts = save(count_words(learning, text_col), "counts")
    texts = learning.count()  # each adds an end token
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, types = total + texts, distinct + (texts > 0)
    vocabulary = vocabulary_of(counts, total)
    unigram = vocabulary.unigram(texts)

    coded = save(encode(docs, vocabulary, id_col, text_col), "coded")
    rows = Parameters(unigram).rows
    for number in range(ROUNDS):
        rows = train_round(coded, rows, unigram, number)
    reached = spark.sparkContext.broadcast((unigram, rows))

    log_total = float(np.log10(train_tokens + SMOOTH * (types + 1)))
    log_end = float(np.log10(texts + SMOOTH))
    kept = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_hashed"]

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        w, near, far, n = contexts(b.column(len(kept)).to_pylist(), "<i4")
        each = Parameters(*reached.value).logs(w, near, far)
        ends = np.concatenate([[0.0], np.cumsum(each)])
        at = np.concatenate([[0], np.cumsum(n)])
        return pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(ends[at[1:]] - ends[at[:-1]])], names=[*kept, "model"])

    modelled = arrow_map(coded.select(*kept, "classes"), run, None, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, log_hashed double, model double", len(kept))
    rare = coded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    tail = rare.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.log10(c + SMOOTH) * F.col("times")).alias("log_rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return modelled.join(tail, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + (1 if texts else 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_all") + log_rare + log_end - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("model") + log_rare - F.col("log_hashed")).alias("score"),
    )
