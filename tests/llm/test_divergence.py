from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import divergence as dv


def brute(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [((d["lang"] or "", d["source"] or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (d["text"] or "").translate(low)))) for d in docs]
    out = set()
    for lang in {g[0] for g, _ in rows}:
        mine = [(g[1], c) for g, c in rows if g[0] == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = sorted((t for t, n in df.items() if n >= 3), key=lambda t: t.encode())
        counts = {s: Counter() for s, _ in mine}
        for s, c in mine:
            counts[s].update({t: n for t, n in c.items() if df[t] >= 3})
        p = lambda c, total: {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        every = sum(counts.values(), Counter())
        all_p, ps = p(every, every.total()), {s: p(c, c.total()) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((ps[s][t] - all_p[t]) ** 2 // all_p[t], t) for t in kept if counts[s][t] and ps[s][t] > all_p[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= 200:
                        out.add((lang, s, part, item, v, k))
    return out


def check(spark, docs):
    rows = [tuple(r) for r in dv.divergence(docs).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute([r.asDict() for r in docs.select("text", "lang", "source").collect()])
    return rows


def test_small_table_in_small_chunks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    assert len(check(spark, docs)) > 1000
    monkeypatch.setattr(dv, "CELLS", 64)
    monkeypatch.setattr(dv, "HELD", 50)
    monkeypatch.setattr(dv, "AUDITED", 1 << 15)
    check(spark, docs)


def test_odd_rows(spark, odd, none):
    assert dv.divergence(none).count() == 0
    check(spark, odd)
    check(spark, odd.unionAll(odd).unionAll(odd))


def test_ties_and_utf8_order(spark):
    words = ["zz", "é", "￿", "😀", "aa", "A", "\xa0b"]  # UTF-8 puts the emoji last, UTF-16 doesn't
    docs = spark.createDataFrame([(f"{w} common", "x", s) for w in words for s in ("b", "é", "a", None) for _ in range(1 + (s == "a"))], "text string, lang string, source string")
    check(spark, docs)


def test_a_text_of_millions_of_characters_and_many_terms(spark):
    long = " ".join(f"w{i % 300_000:x}z" for i in range(700_000)).translate(str.maketrans("0123456789", "ghijklmnop"))
    docs = spark.createDataFrame([(long, "en", s) for s in "abc"], "text string, lang string, source string")
    rows = check(spark, docs)
    assert [r[4] for r in rows if r[2] == "pair"] == [0] * 6  # three equal sources


def test_tasks_take_texts_apart_in_small_parts(spark, monkeypatch):
    whole = dv.byte_words

    def watched(column, inside):
        assert column.nbytes < 9 << 20  # the arrays for 16 MB took some 400 MB in each worker
        return whole(column, inside)

    letters = str.maketrans("0123456789", "ghijklmnop")
    long = " ".join(f"É{i % 30_000:x}z" for i in range(1_600_000)).translate(letters)  # 10 to 20 MB, alone in its task
    rows = [(long, "en", "a"), (long[: len(long) // 3], "en", "b"), ("common é ézz", "en", "b"), (long[-5000:], "en", None)]
    rows += [(" ".join(f"{s}{i:x}z" for i in range(90_000)).translate(letters), "fr", s) for s in "abcb" * 8]  # 20 MB and more in one task
    monkeypatch.setattr(dv, "byte_words", watched)
    check(spark, spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1))
    assert max(p.nbytes for p in dv.parts(pa.py_buffer(long.encode()), dv.GATHERED)) < 9 << 20


@pytest.mark.parametrize("most", [1, 2, 7, 64])
def test_texts_longer_than_a_part(spark, odd, monkeypatch, most):
    monkeypatch.setattr(dv, "GATHERED", most)
    check(spark, odd.unionAll(odd))
    text = "Éa bb,a\x7fÉA " + "long" * 50 + " 😀bb\xa0 a  bb"
    for t in ("", "a", " ", ". .", text, text + ".", "é" * 100):
        cut = list(dv.parts(pa.py_buffer(t.encode()), most))
        assert "".join(p[0].as_py() for p in cut) == t and all(len(p[0].as_py()) for p in cut)
        assert [w for p in cut for w in dv.byte_words(p, dv.IN_TERM)[0].to_pylist()] == dv.byte_words(pa.array([t]), dv.IN_TERM)[0].to_pylist()
    docs = spark.createDataFrame([(text * n, lang, s) for n in (1, 2, 3) for lang in ("x", None) for s in ("b", "é", None)], "text string, lang string, source string")
    check(spark, docs)


@pytest.mark.parametrize("total", [1, 7, 10**9 + 7, 9 * 10**15])
def test_shares_are_exact(total):
    rng = np.random.default_rng(0)
    counts = np.unique(np.append(rng.integers(0, total, 50), [0, total - 1]))
    assert dv.shares(counts, np.array([total])).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
