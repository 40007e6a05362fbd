from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def und(lang):
    return "und" if lang is None else lang


def brute(docs, least=10, share=50, top=2000):
    out = set()
    for lang in {und(d["lang"]) for d in docs}:
        f = Counter()
        for d in docs:
            if und(d["lang"]) == lang:
                for w in pieces(d["text"]):
                    for k in (1, 2, 3):
                        f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in cand.items():
            if any(100 * cand[q] >= share * a for q in cand if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return out


def check(spark, docs, **kw):
    rows = [tuple(r) for r in co.collocations(docs, **kw).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute([r.asDict() for r in docs.select("text", "lang").collect()], **kw)
    return rows


def test_small_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    assert len(check(spark, docs, least=4)) > 100
    monkeypatch.setattr(co, "CELLS", 16)  # nearly all words share cells
    monkeypatch.setattr(co, "HOT", 1 << 30)  # all pivots are hot
    check(spark, docs, least=4, top=30)


def test_fragments_own_each_phrase_once():
    rng = np.random.default_rng(3)
    for _ in range(30):
        number, follows = rng.integers(0, 6, 40), rng.random(40) < 0.8
        follows[-1] = False
        rank = rng.permutation(6)
        rank[rng.integers(0, 6)] = -1
        p, l1, l2, r1, r2 = co.rewritten(number, follows, rank)
        got = Counter()
        for a, b, c, d, e in zip(l2, l1, p, r1, r2, strict=True):
            got.update(g for g in ((b, c), (c, d), (a, b, c), (b, c, d), (c, d, e)) if all(g))
        want = Counter()
        for i, k in itertools.product(range(40), (2, 3)):
            if i + k <= 40 and follows[i : i + k - 1].all() and (rank[number[i : i + k]] >= 0).all():
                want[tuple(number[i : i + k] + 1)] += 1
        assert got == want


def test_rows_are_numbered_exactly():
    rng = np.random.default_rng(4)
    for size in (3, 1 << 20, 1 << 31):
        columns = [rng.integers(0, size, 300)[rng.integers(0, 8, 200)] for _ in range(5)]
        codes, first = co.numbered(columns, size)
        rows = list(zip(*columns, strict=True))
        assert [rows[first[c]] for c in codes] == rows and len(first) == len(set(rows))


def test_odd_rows(spark, odd, none):
    assert co.collocations(none).count() == 0
    check(spark, odd)
    check(spark, odd.unionAll(odd), least=2)


def test_ties_repeats_and_languages(spark):
    rows = [(t, lang, 1) for lang in ("a", None, "und", "") for t in ("x x x x x x", "p q, P q; p  q.\x0bp q", "\xa0é ￿ 😀 é\x00 y\tz") for _ in range(4)]
    found = check(spark, spark.createDataFrame(rows, "text string, lang string, n int"))
    assert {r[0] for r in found} == {"a", "und", ""}


def test_a_text_of_millions_of_characters(spark):
    text = " ".join(f"w{i % 977} w{i % 977 + 1}" for i in range(300_000)) + " " + "x" * 1_000_000
    check(spark, spark.createDataFrame([(text, "en")], "text string, lang string"))


def test_scores_are_exact(spark):
    big = [(10**14 + 7, 10**14 + 9, 10**14 + 8), (999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_998), (10, 10**15 - 1, 10)]
    found = spark.createDataFrame([(2 * i + 1, 2 * i + 2, 0, a) for i, (a, _, _) in enumerate(big)], "x long, y long, z long, a long")
    words = spark.createDataFrame([(2 * i + 1 + k, "en", f"w{i}{k}", n) for i, (_, *ns) in enumerate(big) for k, n in enumerate(ns)], "h long, lang string, word string, n long")
    assert {r.a: r.score for r in co.scored(found, words, 50).collect()} == {a: 10**6 * a * a // (left * right) for a, left, right in big}


def test_another_seed_where_words_share_a_hash(spark, monkeypatch):
    plain = co.word_counts
    monkeypatch.setattr(co, "word_counts", lambda docs, seed, *a: plain(docs, seed, *a).withColumn("h", co.F.lit(5).cast("long")) if seed == 0 else plain(docs, seed, *a))
    check(spark, spark.createDataFrame([("a b c " * 20, "en")], "text string, lang string"))


def test_tokens_follow_within_a_piece():
    t = co.Tokens(pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array(["X y. z", None, "x y"])], names=["l", "t"]))
    assert t.follows.tolist() == [True, False, False, True, False] and t.number.tolist() == [0, 1, 2, 3, 4]
