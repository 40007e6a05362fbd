from __future__ import annotations

import collections

import corpus_pipeline
from tessera.llm.common import documents, save, saved
from tessera.llm.queries import LOWER, UPPER
from tessera.llm.toxicity import toxicity
from test_minhash import brute

FOLD = str.maketrans(UPPER, LOWER)


def test_stages_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        docs.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        seen[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    rows, left = seen["toxicity"]
    toxic = {r.doc_id for r in toxicity(documents(spark, sf), documents(spark, sf, "labels")).where("predicted = 1").collect()}
    assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in rows if r.doc_id not in toxic)
    rows, left = seen["exact_dedup"]
    best = collections.defaultdict(int)
    for r in rows:
        key = (r.text or "").translate(FOLD)
        best[key] = max(best[key], r.doc_id)
    assert sorted(r.doc_id for r in left) == sorted(best.values())
    rows, left = seen["near_dedup"]
    assert sorted(r.doc_id for r in left) == sorted(i for i, (_, _, kept) in brute([(r.doc_id, r.text) for r in rows], 5).items() if kept)
    rows, left = seen["source_mix"]
    times = collections.Counter(r.doc_id for r in left)
    assert set(times) <= {r.doc_id for r in rows} and set(times.values()) <= {1, 2}
    rows, left = seen["packing"]
    assert sum(r.length for r in left if r.piece == 0) > 0 and collections.Counter(r.doc_id for r in left if r.piece == 0) == times


def test_odd_rows(spark, odd, none):
    """Nulls, repeated rows and clashing names through every stage; and an empty table."""
    sf = "/root/testdata/sf0.001"
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = save(stage(spark, docs, sf), f"odd-{name}")
            assert name == "packing" or docs.columns == start.columns
            if name == "exact_dedup" and start is odd:
                assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 2, 4, 5, 7, 8]
        assert (docs.count() > 0) == (start is odd)


def test_run(spark, sf):
    left = len(saved())
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(saved()) == left + 1  # the stages' own tables are gone
