from __future__ import annotations

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney
from tessera.llm.kneser_ney import FIELD, HIGH, LEAST, LOW, ORDER, SLACK, START, STEPS, bounds, classify, count_grams, grams_of, perplexities, train
from tessera.llm.queries import QUERIES


def symbols(text):
    return [START] * (ORDER - 1) + [b + 1 for b in (text or "").encode()]


def number(gram):
    out = 0
    for s in gram:
        out = out << FIELD | s
    return out


@pytest.mark.parametrize("window", (3, 7, 1 << 20))
def test_grams_against_brute_force(monkeypatch, window):
    monkeypatch.setattr(kneser_ney, "WINDOW", window)
    found = ["abcab", None, "", "é", "xy z\n", "q", "", "r"]
    got = [g for _, _, part in grams_of(pa.array(found).slice(1)) for g in part.tolist()]
    assert got == [number(s[i : i + ORDER]) for t in found[1:] for s in [symbols(t)] for i in range(len(s) - ORDER + 1)]


class Brute:
    """Interpolated modified Kneser-Ney as in the textbook, by recursion over tuples."""

    def __init__(self, texts):
        grams = collections.Counter(tuple(s[i : i + ORDER]) for t in texts for s in [symbols(t)] for i in range(len(s) - ORDER + 1))
        self.levels = {ORDER: grams}
        for k in range(ORDER - 1, 0, -1):
            self.levels[k] = collections.Counter(g[1:] for g in self.levels[k + 1])
        self.d, self.contexts = {}, {}
        for k, c in self.levels.items():
            n = [max(1, sum(x == j for x in c.values())) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.d[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.1), j) for j in (1, 2, 3)]
            self.contexts[k] = collections.defaultdict(list)
            for g, x in c.items():
                self.contexts[k][g[:-1]].append(x)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        seen = self.contexts[k].get(gram[:-1], [])
        if not seen:
            return self.p(gram[1:])
        cut = lambda x: min(self.d[k][min(x, 3) - 1], x) if x else 0
        c = self.levels[k][gram]
        return (c - cut(c)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * self.p(gram[1:])

    def perplexity(self, text):
        s = symbols(text)
        logs = [math.log(self.p(tuple(s[i : i + ORDER]))) for i in range(len(s) - ORDER + 1)]
        return math.exp(-sum(logs) / len(logs)) if logs else None


def test_perplexity_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["tree", "house", "sea", "Überall", "walking", "12", "a", "the"]
    rows = [(i, " ".join(rng.choice(words, 12)), "en") for i in range(40)] + [(99, "", "en"), (98, "zzz qqq", "en"), (97, None, None), (None, "the sea", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = [i for i in range(40) if i % 3]
    ids = spark.createDataFrame([(i,) for i in learn], "id long")
    model = train(count_grams(docs, ids, 3))
    brute = Brute([t for i, t, _ in rows if i in learn])
    got = {r.doc_id: r.perplexity for r in perplexities(docs, model, 4).collect()}
    assert set(got) == {i for i, _, _ in rows}
    for i, t, _ in rows:
        want = brute.perplexity(t)
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-4 * want
    every = {r.key: r for r in model.collect()}
    for context in ((), (START,) * (ORDER - 1), tuple(b + 1 for b in b"see")):  # probabilities after a context sum to one
        assert abs(sum(brute.p((*context, b + 1)) for b in range(256)) - 1) < 1e-9
        if context in brute.contexts[len(context) + 1]:
            seen = [x for k, x in every.items() if k and k >> FIELD == number(context) and x.a is not None]
            assert abs(sum(x.a for x in seen) + every[number(context)].lam - 1) < 1e-5


def quantiles(rows):
    """(low, high) of (perplexity, fresh)."""
    every, fresh = sorted(x for x, _ in rows), sorted(x for x, f in rows if f)
    low, high = (math.floor(math.log2(x[math.ceil(len(x) * q) - 1]) * STEPS) for x, q in ((every, LOW), (fresh, HIGH)))
    return 2 ** (low / STEPS), 2 ** ((high + 1) / STEPS)


def test_bounds_against_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [("en", float(x), bool(i % 3)) for i, x in enumerate(rng.lognormal(2, 0.3, 500))] + [(None, float(x), bool(i % 2)) for i, x in enumerate(rng.lognormal(3, 0.1, 40))]
    held = spark.createDataFrame(rows, "lang string, perplexity double, fresh boolean")
    for r in bounds(held, ["lang"]).collect() + bounds(held, []).collect():
        mine = [(x, f) for lang, x, f in rows if "lang" not in r.asDict() or lang == r.lang]
        low, high = quantiles(mine)
        assert r.n == sum(f for _, f in mine) and abs(r.low - low) < 1e-9 and abs(r.high - high) < 1e-9


def test_kept_against_brute_force(spark):
    """The whole query: a model, quantiles and decisions made once more on the driver."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).alias("hold")).distinct().collect()
    brute = Brute([docs[r.doc_id].text for r in ids if not r.hold])
    held = [r.doc_id for r in ids if r.hold]
    got = {r.doc_id: r for r in QUERIES["op4_kneser_ney"](spark, sf).collect()}
    for i in [*held, *list(docs)[:10]]:
        assert abs(got[i].perplexity - brute.perplexity(docs[i].text)) < 1e-4 * got[i].perplexity
    known = [(docs[r.doc_id].lang, got[r.doc_id].perplexity, r.hold) for r in ids if got[r.doc_id].perplexity]
    for r in got.values():
        mine = [(x, f) for lang, x, f in known if lang == docs[r.doc_id].lang]
        low, high = quantiles(mine if sum(f for _, f in mine) >= LEAST else [(x, f) for _, x, f in known])
        words = (docs[r.doc_id].text or "").strip(" \t\n\v\f\r") != ""
        assert r.kept == (r.perplexity is not None and words and (1 - SLACK) * low <= r.perplexity <= (1 + SLACK) * high)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in QUERIES["op4_kneser_ney"](spark, sf).collect()}
    assert sum(kept[i] for i, q in good.items() if q) >= 0.97 * sum(good.values())
    assert sum(not kept[i] for i, q in good.items() if not q) >= 0.85 * sum(1 - q for q in good.values())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0)], "doc_id long, quality int")
    rows = classify(odd, labels).collect()
    assert len(rows) == 9 and not any(r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert sum(r.kept for r in classify(odd, labels.limit(0)).collect()) == 6
    assert classify(none, labels).count() == 0
