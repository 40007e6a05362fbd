from __future__ import annotations

import re

import duckdb
import numpy as np

from tessera.llm.minhash import near_dedup, near_groups, signature
from tessera.llm.queries import LOWER, ORACLE, QUERIES, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def shingles(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=2):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_minhash_near_dedup"](spark, sf).collect()}
    assert got == brute(rows)


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    q = db.execute(ORACLE["op10_minhash_near_dedup"])
    names = [d[0] for d in q.description]
    assert sorted(q.fetchall()) == sorted(tuple(r[n] for n in names) for r in QUERIES["op10_minhash_near_dedup"](spark, sf).collect())


def test_chains_and_families(spark):
    """Neighbours of a chain are similar, its ends are not; families share a common passage."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows, text = [], [words[i] for i in rng.integers(0, 5000, 60)]
    for i in range(12):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[rng.integers(0, 60)] = words[rng.integers(0, 5000)]
        text[rng.integers(0, 60)] = words[rng.integers(0, 5000)]
    common = [words[i] for i in rng.integers(0, 5000, 50)]
    for i in range(12, 60):
        rows.append((i, " ".join(common + [words[j] for j in rng.integers(0, 5000, int(rng.integers(1, 20)))])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_odd_rows(odd, none):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_groups(odd).collect())
    assert [(i, n, c) for i, n, c, _ in got if i in (1, 2, 3, 4, 5)] == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert near_groups(none).count() == 0 and near_dedup(none).count() == 0
    assert set(near_dedup(odd).columns) == set(odd.columns)


def test_rows_that_share_a_doc_id(spark):
    one, other = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven"
    rows = [(2, one), (2, one), (2, other), (2, one.upper()), (None, other), (7, other + " "), (8, ""), (9, None), (9, None)]
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == [(2, one), (2, other), (8, ""), (9, "")]


def test_one_bucket_with_most_rows(spark):
    """Salted: 600 documents that differ in one word of 40."""
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{words} own{i}") for i in range(600)] + [(1000 + i, f"a{i} b{i} c{i}") for i in range(300)], "doc_id long, text string")
    rows = near_groups(docs.repartition(4)).collect()
    assert {r.component_id for r in rows if r.doc_id < 1000} == {0} and sum(r.kept for r in rows) == 301


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (2, 30, 5000):
        pool = np.sort(rng.integers(0, 2**64, n + n // 4, dtype=np.uint64))
        a, b = pool[:n], np.sort(rng.choice(pool, n, replace=False))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signature(np.sort(a)) == signature(b)).mean() - exact) < (0.5 if n < 10 else 0.2)
