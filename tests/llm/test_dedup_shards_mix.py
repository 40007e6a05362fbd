from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_dedup, exact_groups, grace
from tessera.llm.mixing import mix_documents, mix_totals, slot_schedule, source_targets
from tessera.llm.queries import LOWER, QUERIES, UPPER
from tessera.llm.sharding import minimax_cuts, shard_by_bytes

FOLD = str.maketrans(UPPER, LOWER)


def test_exact_groups_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op3_exact_dedup"](spark, sf).collect()}
    assert got == want


def test_spilling_changes_nothing(odd, none):
    rows = lambda n: sorted(map(tuple, exact_groups(odd, table_bytes=n).collect()), key=str)
    assert rows(1) == rows(1 << 30)
    assert sum(r[3] for r in rows(1)) == 6
    assert exact_groups(none).count() == 0
    assert sorted(r.doc_id or 0 for r in exact_dedup(odd).collect()) == [0, 2, 4, 5, 7, 8]


def test_grace_keeps_colliding_hashes_apart():
    records = [(5, bytes([i % 7]), i) for i in range(100)]

    def fold(state, row):
        state.append(row)
        return row

    out = list(grace(iter(records), list, fold, budget=300))
    assert sorted(r for c, r in out if c is None) == list(range(100))
    assert {c: sorted(x) for c, x in out if c is not None} == {bytes([k]): list(range(k, 100, 7)) for k in range(7)}


def test_a_text_that_many_rows_share(spark):
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "The same text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    got = exact_groups(docs, table_bytes=1 << 16).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(200_000, True, 1), (200_000, False, 199_999), (1, True, 100_000)}


def test_rows_that_share_a_doc_id(spark):
    rows = [(2, "ALPHA one"), (2, "beta two"), (9, "beta two"), (5, "Gamma three"), (5, "gamma three"), (6, None), (6, ""), (None, "x"), (None, "X")]
    kept = [tuple(r) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((i or 0, (t or "").lower()) for i, t in kept) == [(0, "x"), (2, "alpha one"), (5, "gamma three"), (6, ""), (9, "beta two")]


def test_minimax_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes, shards = rng.integers(0, 20, rng.integers(1, 9)), int(rng.integers(1, 5))
        cuts = minimax_cuts(sizes.astype(np.int64), shards)
        best = {(0, 0): 0}
        for j in range(1, shards + 1):
            for n in range(len(sizes) + 1):
                best[j, n] = min((max(best[j - 1, m], sizes[m:n].sum()) for m in range(n + 1) if (j - 1, m) in best), default=None)
                if best[j, n] is None:
                    del best[j, n]
        edges = [*cuts, len(sizes)]
        assert max(sizes[a:b].sum() for a, b in zip(edges, edges[1:], strict=False)) == best[shards, len(sizes)]


def test_shards(spark, sf, odd, none):
    rows = QUERIES["op5_minimax_shards"](spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(t) + 16, zlib.crc32(t)) for i, t in texts.items())
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(40))
    assert max(load.values()) <= sum(load.values()) / 40 + max(r.size for r in rows)
    by_text = {}
    for r in shard_by_bytes(odd, 3).collect():
        assert by_text.setdefault(r.text_crc32, r.shard) == r.shard
    assert shard_by_bytes(none).count() == 0


def water_level(cups, amount):
    """The level at which cups (volume, width) hold `amount`, by bisection."""
    low, high = 0.0, amount
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(v, mid * w) for v, w in cups.values()) < amount else (low, mid)
    return low


def test_targets(spark):
    sizes = {"a": 5, "b": 1000, "c": 40, "d": 300, None: 60}
    docs = spark.createDataFrame(list(sizes.items()), "source string, size long")
    weight = dict(zip(sizes, (5, 2, 1, 5, 2), strict=True))
    level = water_level({n: (2 * x, weight[n]) for n, x in sizes.items()}, 1.5 * sum(sizes.values()))
    for r in source_targets(docs).collect():
        assert r.source_size == sizes[r.source] and abs(r.target - min(2 * r.source_size, level * weight[r.source])) < 1e-6


def test_schedule_has_low_discrepancy(spark):
    """Of any first slots a source has its share, up to a few."""
    targets = spark.createDataFrame([(0, 51200, 51200.0), (1, 102400, 102400.0), (2, 5120, 5120.0)], "place int, source_size long, target double")
    rows = sorted(slot_schedule(targets, 512).collect())
    seen, share = [0, 0, 0], (100, 200, 10)
    for k, r in enumerate(rows[:300]):
        assert r.rank == seen[r.place] and r.take == 512
        seen[r.place] += 1
        assert all(abs(n - (k + 1) * s / 310) < 5 for n, s in zip(seen, share, strict=True))
    assert [sum(r.place == p for r in rows) for p in range(3)] == [*share]


def test_mix(spark, sf, odd, none):
    rows = QUERIES["op8_source_mix"](spark, sf).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, by_source = 0, collections.defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        total += r.size
        s = by_source[texts[r.doc_id].source]
        s[:] = s[0] + r.size, r.target, s[2] + r.taken
    assert abs(sum(s[1] for s in by_source.values()) - 1.5 * total) < 1e-6 * total
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by_source))}
    level = water_level({n: (2 * s[0], weight[n]) for n, s in by_source.items()}, 1.5 * total)
    for n, (size, target, taken) in by_source.items():
        assert abs(taken - target) <= 1 and target <= 2 * size
        assert abs(target - min(2 * size, level * weight[n])) < 1e-6 * total
    again = QUERIES["op8_source_mix"](spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert len(mix_totals(odd, block=4).collect()) == 9
    assert mix_totals(none).count() == 0 and mix_documents(none).count() == 0
    assert set(mix_documents(odd, block=4).columns) == set(odd.columns)
