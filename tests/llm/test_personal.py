from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from tessera.llm import personal as pp
from tessera.llm.queries import QUERIES

PLAIN = [
    (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, m: True),
    (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(x) <= 255 for x in m.split("."))),
    (2, r"[0-9]([\x20-]?[0-9])+", lambda d, m: 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 10 <= len(d) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text) if ok(re.sub("[^0-9]", "", m[0]), m[0]))


def test_patterns_against_plain_expressions():
    rng = np.random.default_rng(1)
    bits = ["a@b.c", "x%y@", "@", ".", "1", "12", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+1 (212) 555-0100", "+", "(", ")", " ", "-", "\n", "é", "😀", "b.co", "1.2.3.4", "0", "00000000000255", "+123456789012345"]
    for _ in range(4000):
        text = "".join(rng.choice(bits, rng.integers(1, 14)))
        assert pp.patterns(text) == brute(text), text


def test_patterns_take_linear_time():
    for bit in ("a", "1", "1.", "a@", "1 ", "+1", "+1 (", "@", "a.", "1.1.1 "):
        pp.patterns(bit * (3_000_000 // len(bit)) + "x@y.z")
    assert pp.patterns("1" * 3_000_000 + " a@b.c")[-1][1] == 0


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    net = pp.Network(3, hidden=4)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.steps += rng.normal(size=net.steps.shape)
    x, tags = rng.integers(0, 8, (3, 7)), np.zeros((3, 7), int)
    tags[0, 2:5], tags[1, :3] = [1, 2, 2], [2, 0, 3]
    _, grads = net.gradient(x, tags)
    for k in net.NAMES:
        value = getattr(net, k)
        places = [i for i in np.ndindex(value.shape) if k != "inputs" or i[1] < 8]
        for i in [places[j] for j in rng.integers(0, len(places), 6)]:
            if k == "steps" and not pp.ALLOWED[i]:
                continue
            kept, sides = value[i], []
            for e in (1e-3, -1e-3):
                value[i] = kept + e
                sides.append(net.gradient(x, tags)[0])
            value[i] = kept
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(grads[k][i], abs=2e-4), (k, i)


def test_marginals_and_best_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    net = pp.Network()
    net.steps, net.first, e = rng.normal(size=(pp.TAGS, pp.TAGS)), rng.normal(size=pp.TAGS), rng.normal(size=(1, 4, pp.TAGS))
    total, on, top = 0.0, np.zeros((4, pp.TAGS)), (-1.0, None)
    for path in itertools.product(range(pp.TAGS), repeat=4):
        if all(pp.ALLOWED[a, b] for a, b in zip(path, path[1:], strict=False)):
            w = np.exp(net.first[path[0]] + sum(e[0, i, t] for i, t in enumerate(path)) + sum(net.steps[a, b] for a, b in zip(path, path[1:], strict=False)))
            total, top = total + w, max(top, (w, path))
            on[np.arange(4), path] += w
    p, _, log = net.marginals(e)
    assert np.allclose(p[0], on / total) and np.isclose(log[0], np.log(total)) and tuple(net.best(e)[0]) == top[1]


def test_windows_are_reconciled():
    cut = [[10, 96, 0, 0.9, False, True], [48, 130, 0, 0.9, True, False], [96, 130, 0, 0.7, True, False]]
    text = "x" * 10 + "a" * 60 + "@" + "b" * 50 + ".cdefghi" + "y" * 100
    assert pp.reconciled([list(c) for c in cut], text, []) == [(10, 0, 130, 0.9)]
    assert pp.reconciled([list(c) for c in cut], text, [(129, 1, 140)]) == []
    assert pp.reconciled([list(c) for c in cut], text, [(0, 1, 10), (130, 1, 140)])
    number = "call 212 555 0100 212 555 0101 now"
    spans = [[5, 17, 3, 0.9, False, False], [18, 30, 3, 0.9, False, False], [5, 30, 3, 0.7, False, False]]
    assert [s[:3] for s in pp.reconciled(spans, number, [])] == [(5, 3, 17), (18, 3, 30)]


@pytest.fixture(scope="module")
def net(spark):
    return pp.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 <> 0"))


def test_held_out_spans_and_clean_texts(spark, net):
    """Without the patterns the network finds most of what they find in unseen texts, and hardly anything else."""
    held = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0").collect() if r.text]
    base = [pp.patterns(t) for t in held]
    alone = [{s[:3] for s in f} for f in pp.added(net, held, [[] for _ in held])]
    hits = sum(len(f & set(b)) for f, b in zip(alone, base, strict=True))
    assert hits >= 0.85 * sum(map(len, base)) and hits >= 0.95 * sum(map(len, alone))
    assert sum(bool(f) for f, b in zip(alone, base, strict=True) if not b) <= 0.01 * len(held)


def test_numbers_glued_together_are_parted(net):
    glued = ["the hand of +1 (269) 555-3296 4795326016703902 and there", "is 4524132264652876 +1 (644) 555-7859 the one of", "and it 99.114.106.61 4795326016703902 was on the"]
    want = [["+1 (269) 555-3296", "4795326016703902"], ["4524132264652876", "+1 (644) 555-7859"], ["99.114.106.61", "4795326016703902"]]
    found = []
    for text, spans in zip(glued, want, strict=True):
        base = pp.patterns(text)
        got = {text[a:z] for a, _, z in base} | {text[a:z] for a, _, z, _ in pp.added(net, [text], [base])[0]}
        found += [s in got for s in spans]
    assert sum(found) >= 5, found


def test_query_derives_its_digests_and_keeps_the_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_bilstm_crf_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = [f"{pp.KINDS[k]}:{a}:{z}" for a, k, z in brute(texts[r.doc_id])]
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in pp.KINDS)
        cells = [(int(a), pp.KINDS.index(k), int(z)) for k, a, z in (s.split(":") for s in spans)]
        assert cells == sorted(cells)


def test_labelled_spans_of_a_table(spark):
    docs = spark.createDataFrame([(i, f"order {i} for user {i}@home.example please"[: 40 + i % 3]) for i in range(60)], "doc_id long, text string")
    spans = docs.selectExpr("doc_id", "'email' as kind", "instr(text, 'user') + 4 as start", "instr(text, '.example') + 7 as end")
    assert pp.train(docs, spans) is not None and pp.train(docs, spans.limit(0)) is None


def test_odd_rows(spark, odd, none):
    assert pp.personal(none).count() == 0
    rows = pp.personal(odd).collect()
    assert len(rows) == 9 and all(r.spans == "" for r in rows)
    mail = spark.createDataFrame([(None, "a@b.cd", 1), (3, "a@b.cd", 1), (3, "a@b.cd", 1), (4, None, 1)], "doc_id long, text string, spans int")
    assert sorted((r.doc_id or 0, r.spans, r.n_email) for r in pp.personal(mail).collect()) == [(0, "email:0:6", 1), (3, "email:0:6", 1), (3, "email:0:6", 1), (4, "", 0)]


def test_a_text_of_millions_of_characters(spark, net):
    text = "the hand " * 300_000 + "on +1 (269) 555-3296 4111111111111111 " + "é and " * 300_000 + " x@y.zz"
    r = pp.tagged(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert [text[s.start : s.end] for s in r.spans if s.base] == ["x@y.zz"] and all(text[s.start : s.end] in ("+1 (269) 555-3296", "4111111111111111") for s in r.spans if not s.base)
