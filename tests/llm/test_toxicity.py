from __future__ import annotations

import itertools
import zlib

import numpy as np

from tessera.llm.queries import QUERIES
from tessera.llm.toxicity import Model, Scorer, _marginals, drop_toxic, toxicity


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=(3, 6)), rng.normal(size=(2, 2))
    got, pairs = _marginals(e, trans)
    for i in range(3):
        total, on, both = 0.0, np.zeros(6), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=6):
            path = (0, *tags)
            p = np.exp(sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[i, k] for k in range(6) if tags[k]))
            total += p
            on += p * np.array(tags)
            for a, b in zip(path, path[1:], strict=False):
                both[a, b] += p
        assert np.allclose(got[i], on / total) and np.allclose(pairs[i], both / total)


def test_gaps_are_exact():
    rng = np.random.default_rng(1)
    model = Model(0.1, ["w:x"], np.array([4.0]), -2.0, rng.normal(size=(2, 2)))
    scorer, at, gain = Scorer(model), np.array([3, 4, 40, 199]), np.array([4.0, 2.0, 5.0, 1.0])
    e = np.full(200, -2.0)
    e[at] += gain
    assert np.allclose(scorer.marginals(at, gain, 200), _marginals(e[None], model.trans)[0][0, at])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert sum(p for p, t in held if t) >= 0.6 * sum(t for _, t in held)


def test_the_stage_drops_what_the_scores_reject(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rejected = {r.doc_id for r in toxicity(docs, labels).where("predicted = 1").collect()}
    left = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert rejected and not rejected & left and len(rejected) + len(left) == docs.count()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity(odd, labels).count() == 9 and toxicity(none, labels).count() == 0
    assert toxicity(odd, labels.limit(0)).where("predicted = 0").count() == 9
    docs = spark.createDataFrame([(i, ("you slurrish fool. " if i % 3 == 0 else "a good day. ") + f"text {i}", i) for i in range(300)], "doc_id long, text string, score long")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300)], "doc_id long, toxic int")
    kept = drop_toxic(docs, marks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 3]
    few = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")  # nothing can be learnt from these
    assert drop_toxic(docs.limit(49), few).count() == 49
    assert drop_toxic(odd, few).count() == 9 and drop_toxic(none, few).count() == 0
