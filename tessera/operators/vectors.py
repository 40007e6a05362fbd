"""The nearest vectors of many questions by cosine: exactly, or through inverted lists around centroids.

Either way a question meets the vectors of its lists in blocks: a list of more than PART vectors, or one asked by more than ASKED
questions, is dealt to several blocks by hash, and a block is one product of two matrices in one task that keeps the best k of each
of its questions. So no task gets a whole list, and the plan is the same for any number of questions. Exact search has one list.

Centroids are fitted on at most SAMPLE vectors, those whose ids have the least hashes, in one task; there are about as many as the
square root of the number of vectors, MOST_LISTS at most, so that what every task gets of them is bounded. Every vector goes into the
list of its nearest centroid, and a question asks the `probes` lists with the nearest ones: as many as find RECALL of the NEAR nearest
neighbours of TRIED of the sampled vectors within the sample, where neighbours lie farther off than in the whole table.

Vectors that are null or without length are never found; a question of that kind finds nothing. Ties fall to the lesser id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST_LISTS, ROUNDS = 40_000, 1024, 8
RECALL, NEAR, TRIED = 0.97, 4, 400
PART = ASKED = 2048


def matrix(column) -> np.ndarray:
    """Rows of length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def spherical_means(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of length 1 by k-means; a list that loses all vectors starts again at the vector worst served."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = x @ c.T
        at, served = near.argmax(1), near.max(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        total[empty] = x[np.argsort(served)[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def probes_for(x: np.ndarray, centroids: np.ndarray) -> int:
    tried = x[:TRIED]
    score = tried @ x.T
    near = np.argpartition(-score, min(NEAR, len(x)) - 1, axis=1)[:, :NEAR]
    turn = np.argsort(np.argsort(-(tried @ centroids.T), axis=1), axis=1)  # of each list for each question
    at = (x @ centroids.T).argmax(1)[near]
    return int(np.quantile(np.take_along_axis(turn, at, 1), RECALL, method="higher")) + 1


def fit_centroids(vectors: DataFrame, id_col: str = "id", vector: str = "embedding", lists: int | None = None) -> tuple[np.ndarray, int]:
    """At most MOST_LISTS centroids, and how many lists a question should ask."""
    known = usable(vectors, vector)
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(known.count())))

    def run(batches: Iterator[pa.RecordBatch]):
        held = [matrix(b.column(0)) for b in batches if len(b)]
        if held:
            x = np.concatenate(held)
            c = spherical_means(x, lists)
            yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), pa.list_(pa.float64())), pa.array([probes_for(x, c)] * len(c), pa.int32())], names=["centroid", "probes"])

    sample = known.select(vector, id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector)
    found = sample.repartition(1).mapInArrow(run, "centroid array<double>, probes int").collect()
    return np.array([r.centroid for r in found]), found[0].probes if found else 0


def into_lists(rows: DataFrame, centroids: np.ndarray, id_col: str, vector: str, probes: int = 1) -> DataFrame:
    """(list, id, vector): each row under its `probes` nearest centroids."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if len(b):
                near = matrix(b.column(1)) @ centroids.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(b)), best.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).cast(pa.list_(pa.float32())).take(at)], names=["list", "id", "vector"])

    return usable(rows, vector).select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vector")).mapInArrow(run, f"list int, id {id_type}, vector array<float>")


def nearest(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """question_id, id, score, rank from index(list, id, vector) and asked(list, id, vector), which are joined by list."""
    parts = lambda rows, size, name: rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    shape = parts(index, PART, "parts").join(parts(asked, ASKED, "asked_parts"), "list")  # a row a list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = index.join(F.broadcast(shape), "list").select("list", at("parts").alias("part"), spread("asked_parts").alias("asked_part"), "id", "vector")
    right = asked.join(F.broadcast(shape), "list").select("list", spread("parts").alias("part"), at("asked_parts").alias("asked_part"), "id", "vector")
    kind, ask_kind = (f.schema["id"].dataType.simpleString() for f in (index, asked))

    def best(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        if not len(vectors) or not len(questions):
            return pa.table({"question_id": questions.column("id").slice(0, 0), "id": vectors.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        vectors = vectors.sort_by("id")
        score = np.round(matrix(questions.column("vector")) @ matrix(vectors.column("vector")).T, 12)  # copies of a vector tie
        most = min(k, score.shape[1])
        bound = -np.partition(-score, most - 1, axis=1)[:, most - 1]
        row, column = np.nonzero(score >= bound[:, None])  # by id within a question
        order = np.lexsort((column, -score[row, column], row))
        row, column = row[order], column[order]
        first = np.searchsorted(row, np.arange(score.shape[0]))
        keep = np.arange(len(row)) - first[row] < most
        row, column = row[keep], column[keep]
        return pa.table({"question_id": questions.column("id").take(pa.array(row)), "id": vectors.column("id").take(pa.array(column)), "score": pa.array(score[row, column])})

    keys = ["list", "part", "asked_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"question_id {ask_kind}, id {kind}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, questions: DataFrame, k: int = 4) -> DataFrame:
    """For questions(question_id, vector), the k nearest of vectors(id, embedding), exactly: question_id, id, score, rank."""
    one = lambda rows, id_col, vector: usable(rows, vector).select(F.lit(0).alias("list"), F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    return nearest(one(vectors, "id", "embedding"), one(questions, "question_id", "vector"), k)


def search_lists(index: DataFrame, questions: DataFrame, centroids: np.ndarray, probes: int, k: int = 4) -> DataFrame:
    """As search, among the vectors of each question's nearest lists; index is into_lists() of all vectors, stored or not."""
    return nearest(index, into_lists(questions, centroids, "question_id", "vector", probes), k)
