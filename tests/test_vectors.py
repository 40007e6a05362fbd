from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as v


@pytest.fixture(scope="module")
def chunks(spark):
    """6,000 vectors around 40 centres of very different sizes; a tenth are copies of one."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = centres[np.minimum(rng.geometric(0.08, 6000) - 1, 39)] + 0.5 * rng.normal(size=(6000, 24))
    x[::10] = x[0]
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, embedding array<float>").repartition(6).cache()


def asked(chunks):
    return chunks.where("id % 50 = 7 or id % 100 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))


def brute(chunks, k=4):
    rows = sorted((r.id, r.embedding) for r in chunks.collect())
    x = np.array([e for _, e in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, _ in rows:
        if i % 50 == 7 or i % 100 == 0:
            s = np.round(x @ x[i], 12)
            out[i] = np.lexsort((np.arange(len(x)), -s))[:k].tolist()
    return out


def by_question(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.question_id, []).append(r.id)
    return out


def test_exact_in_any_blocks(chunks, monkeypatch):
    want = brute(chunks)
    assert by_question(v.search(chunks, asked(chunks)).collect()) == want
    monkeypatch.setattr(v, "PART", 100)
    monkeypatch.setattr(v, "ASKED", 17)
    assert by_question(v.search(chunks, asked(chunks)).collect()) == want


def test_recall_and_cost_of_lists(chunks):
    want, (centroids, probes) = brute(chunks), v.fit_centroids(chunks)
    index = v.into_lists(chunks, centroids, "id", "embedding").cache()
    assert sorted(r.id for r in index.collect()) == list(range(6000))  # every vector is in a list
    rows = v.search_lists(index, asked(chunks), centroids, probes).collect()
    got = by_question(rows)
    hits = sum(len(set(got[q]) & set(ids)) for q, ids in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    sizes = {r.list: r["count"] for r in index.groupBy("list").count().collect()}
    compared = sum(sizes.get(r.list, 0) for r in v.into_lists(asked(chunks), centroids, "question_id", "vector", probes).collect())
    assert compared < 0.4 * 6000 * len(want)
    everywhere = v.search_lists(index, asked(chunks), centroids, len(centroids)).collect()
    assert by_question(everywhere) == want


def test_the_plan_does_not_grow_with_the_questions(chunks, monkeypatch):
    plan = lambda n: v.search(chunks, asked(chunks).limit(n))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    monkeypatch.setattr(v, "ASKED", 2)
    assert plan(5) == plan(180)


def test_recall_on_the_table(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    ask = chunks.where("id % 50 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))
    want, (centroids, probes) = by_question(v.search(chunks, ask).collect()), v.fit_centroids(chunks)
    got = by_question(v.search_lists(v.into_lists(chunks, centroids, "id", "embedding"), ask, centroids, probes).collect())
    assert sum(len(set(got[q]) & set(ids)) for q, ids in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [None, 1.0]), (5, [1.0, 0.0])], "id long, embedding array<float>")
    ask = rows.select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))
    assert by_question(v.search(rows, ask).collect()) == {3: [3, 5], 5: [3, 5]}
    assert v.search(rows.limit(0), ask).count() == 0 and v.search(rows, ask.limit(0)).count() == 0
    assert v.fit_centroids(rows)[1] == 1 and v.fit_centroids(rows.limit(0))[1] == 0
