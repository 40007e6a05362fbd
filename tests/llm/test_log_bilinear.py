from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import log_bilinear
from tessera.llm.log_bilinear import HASHED, SMOOTH, VOCABULARY, Parameters, contexts, hashed_class, nce, score, vocabulary_of
from tessera.llm.queries import LOWER, QUERIES, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def base(rows):
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens]


def test_base_and_model(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in QUERIES["op6_log_bilinear"](spark, sf).collect()}
    for i, held, n, known, total, b in base(docs):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - b) < 1e-6 * max(1, abs(b)) and r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tables_are_normalised():
    rng = np.random.default_rng(0)
    p = Parameters(np.full(VOCABULARY, 1 / VOCABULARY))
    p.vectors, p.bias = rng.normal(size=p.vectors.shape), rng.normal(size=p.bias.shape)
    near, far, bias, z = p.table()
    for a, b in ((0, 0), (5, 900), (1023, 1)):
        assert abs((10.0 ** (near[a] + far[b] + bias - z[b, a]).astype(float)).sum() - 1) < 1e-3


def test_contexts():
    w, near, far, n = contexts([np.array(x, "<i2").tobytes() for x in ([5, 6, 7, 0], [0], [8, 0])])
    assert near.tolist() == [0, 5, 6, 7, 0, 0, 8] and far.tolist() == [0, 0, 5, 6, 0, 0, 0] and n.tolist() == [4, 1, 2]


def test_odd_rows(spark, odd, none):
    want = sorted((x[:5] for x in base([(r.doc_id, r.text) for r in odd.collect()])), key=str)
    assert sorted((tuple(r)[:5] for r in score(odd).collect()), key=str) == want
    assert score(none).count() == 0
    assert score(odd.where("doc_id is null")).count() == 1


def test_two_levels():
    rng = np.random.default_rng(0)
    p = Parameters(np.full(30, 1 / 30))  # one bin
    near, far, bias, z = p.table()
    w, a, b = (rng.integers(0, 30, 200) for _ in range(3))
    assert np.abs(p.logs(w, a, b) - (near[a, w] + far[b, w] + bias[w] - z[b, a])).max() < 1e-4
    n = 3000
    p = Parameters(rng.dirichlet(np.ones(n)))
    p.rows[: n + len(p.bin_vectors)] = rng.normal(size=(n + len(p.bin_vectors), p.rows.shape[1]))
    for a, b in ((0, 1), (2900, 7)):
        assert len(p.bin_vectors) > 1 and abs((10.0 ** p.logs(np.arange(n), np.full(n, a), np.full(n, b))).sum() - 1) < 1e-3


def test_hashed_classes(spark):
    words = [f"w{i}" for i in range(3000)] + ["é", "x" * 100, "日本"]
    rows = spark.createDataFrame([(w, 9 if i < 2000 else 1 + i % 4) for i, w in enumerate(words)], "word string, n long")
    of_spark = {r.word: r.k for r in rows.select("word", F.pmod(F.xxhash64("word"), F.lit(HASHED)).alias("k")).collect()}
    assert hashed_class(pa.array(words)).tolist() == [of_spark[w] for w in words]
    v = vocabulary_of(rows, 1 << 20)
    assert sorted(v.words.to_pylist()) == sorted(words[:2000]) and v.own == 2000
    want = collections.Counter()
    for r in rows.where("n < 5").collect():
        want[of_spark[r.word]] += r.n
    assert v.hashed.sum() == sum(want.values()) and all(v.hashed[k] == n for k, n in want.items()) and v.hashed_types.sum() == 1003
    # shares in a class and that of unseen words sum to one
    k = max(want, key=want.get)
    inside = [r.n for r in rows.where("n < 5").collect() if of_spark[r.word] == k]
    assert abs(sum(n + SMOOTH for n in inside) + SMOOTH - (v.hashed[k] + SMOOTH * (v.hashed_types[k] + 1))) < 1e-9


def test_a_step_against_its_definition():
    """Gradients token by token, over texts that start within the block and before it."""
    rng = np.random.default_rng(3)
    n, dim = 80, log_bilinear.DIMENSION
    w, near, far, _ = contexts([np.append(rng.integers(1, n, k), 0).astype("<i4").tobytes() for k in (5, 1, 0, 7)], "<i4")
    w, near, far = w[2:], near[2:], far[2:]
    p = Parameters(rng.dirichlet(np.ones(n)))
    p.rows[:, :dim] = rng.normal(0, 0.5, (len(p.rows), dim))
    old, bins = p.rows.astype(np.float64), len(p.bin_vectors)
    places, lines = old[n + bins :, :dim].reshape(2, dim, dim), np.arange(dim)
    drawn, log_noise = [rng.integers(0, n, 6), n + rng.integers(0, bins, 6)], np.log(6 * p.share)
    grad, sigmoid = np.zeros_like(old), lambda x: 1 / (1 + np.exp(-x))
    for x, a, b in zip(w, near, far, strict=True):
        q, dq = old[a, :dim] @ places[0] + old[b, :dim] @ places[1], np.zeros(dim)
        for target, noise in ((x, drawn[0]), (n + p.bin_of[x], drawn[1])):
            for row, sign in [(target, 1), *((k, -1) for k in noise)]:
                delta = old[row, :dim] @ q + old[row, dim] - log_noise[row]
                up = sign * sigmoid(-sign * delta)
                grad[row, :dim] += up * q
                grad[row, dim] += up
                dq += up * old[row, :dim]
        for k, c in ((0, a), (1, b)):
            grad[c, :dim] += places[k] @ dq
            grad[n + bins + k * dim + lines, :dim] += np.outer(old[c, :dim], dq)
    squares, used = np.ones_like(p.rows), np.zeros(len(p.rows))
    nce(p, squares, used, w, near, far, drawn, log_noise.astype(np.float32))
    assert np.abs(p.rows - (old + log_bilinear.RATE * grad / np.sqrt(1 + grad**2))).max() < 1e-4


def test_known_words_without_vectors_score_as_joined_ones(spark, monkeypatch):
    """Whether a word's count is at hand or joined changes no score."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in (rng.pareto(0.5, 60) * 3).astype(int) % 4000)) for i in range(300)], "doc_id long, text string").repartition(1)
    monkeypatch.setattr(log_bilinear, "VOCABULARY", 64)
    monkeypatch.setattr(log_bilinear, "SHARE", 1 << 8)
    monkeypatch.setattr(log_bilinear, "LEAST", 1)
    got = []
    for known in (1 << 8, 1 << 20):
        monkeypatch.setattr(log_bilinear, "KNOWN", known)
        got.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in score(docs).collect()})
    assert all(abs(a - b) < 1e-4 * max(1, abs(a)) for i in got[0] for a, b in zip(got[0][i], got[1][i], strict=True))


@pytest.mark.parametrize("share", (1 << 20, 1 << 4))  # words with vectors; hashed classes but for the most frequent
def test_context_reaches_all_words(spark, monkeypatch, share):
    """1,600 frequent words; then 300 pairs of rarer ones, each of whose second words follows only its first."""
    monkeypatch.setattr(log_bilinear, "SHARE", share)
    rng = np.random.default_rng(0)
    often = [" ".join(f"w{x}" for x in rng.integers(0, 1600, 200)) for _ in range(200)]
    pairs = [" ".join(f"a{x} b{x}" for x in rng.permutation(300)[:100]) for _ in range(48)]
    docs = spark.createDataFrame(list(enumerate(often + pairs)), "doc_id long, text string")
    ids = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    asked = spark.createDataFrame([(ids[0], " ".join(f"a{x} b{x}" for x in range(300))), (ids[1], " ".join(f"a{x} b{(x + 150) % 300}" for x in range(300)))], docs.schema)
    rows = {r.doc_id: r for r in score(docs.union(asked)).collect()}
    assert abs(rows[ids[0]].base_score - rows[ids[1]].base_score) < 1e-6  # the same words
    assert rows[ids[0]].score > rows[ids[1]].score + 1
