from __future__ import annotations

import collections
import re

import duckdb
from pyspark.sql import functions as F

from tessera.llm.license_rules import MENTIONS, STATEMENTS
from tessera.llm.licenses import BASE, WORD, gate, licenses, rules
from tessera.llm.quality_rules import CURRENT, POLICIES, RULES, ablations, apply_policy, ledger, quality
from tessera.llm.queries import LOWER, ORACLE, QUERIES, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op2_quality_rules"](spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    got = sorted(tuple(r)[1:6] for r in quality(odd).collect())
    assert got == sorted(measures(r.text) for r in odd.collect())
    assert quality(none).count() == 0 and ablations(apply_policy(ledger(none))).count() == 0


def test_rules_oracle(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    q = db.execute(ORACLE["op2_quality_rules"])
    names = [d[0] for d in q.description]
    assert sorted(q.fetchall()) == sorted(tuple(r[n] for n in names) for r in QUERIES["op2_quality_rules"](spark, sf).collect())


def test_license_oracle(spark, tmp_path):
    """On the table, and on a text for each rule, some with two matches side by side."""
    made = [t for _, _, _, p, _ in rules() for t in examples(re._parser.parse(p))[:2]]
    docs = spark.createDataFrame([(i, f"Word {t}; {t.upper()} {made[i - 1]} end") for i, t in enumerate(made)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/made")
    for docs, files in ((docs, f"{tmp_path}/made/*.parquet"), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01/documents.parquet")):
        db = duckdb.connect()
        db.execute(f"create view documents as select * from '{files}'")
        q = db.execute(ORACLE["op7_license_rules"])
        names = [d[0] for d in q.description]
        key = lambda r: r[0]
        assert sorted(q.fetchall(), key=key) == sorted((tuple(r[n] for n in names) for r in licenses(docs).collect()), key=key)


def test_ablations(spark, sf):
    rows = ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r.failures & POLICIES[CURRENT] for r in rows.collect()]
    for r in ablations(rows).collect():
        bit = 1 << list(RULES).index(r.rule)
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit != 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits))


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    base = sorted((i, x) for p, x in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    padded = f" {' '.join(w)} " if w else ""
    spans = []
    for turn, (priority, label, _, pattern, confidence) in enumerate(rules()):
        for m in re.finditer(f" ({pattern})(?= )", padded):
            start = padded[: m.start()].count(" ")
            spans.append((start, -(start + m[0].count(" ")), -priority, turn, label, confidence))
    kept = []
    for s in sorted(spans):
        if not any(k[1] <= s[1] and k[2] <= s[2] for k in kept):
            kept.append(s)
    labels = {s[4] for s in kept} | {x for _, x in base}
    score = max([0.0, *(s[5] for s in kept), *(0.8 for _ in base)])
    first, last = (base[0][0], base[-1][0]) if base else (None, None)
    return len(w), len(base), first, last, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, len(kept)


def test_licenses(spark, sf, odd, none):
    extra = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: GPL-3.0-or-later. GNU General Public License v3, gpl gpl GPL",
        "CC BY-SA 4.0 and cc-by, CC BY. CC BY is not one; ALL RIGHTS RESERVED all rights reserved",
        "Released under the MIT License. Copyright (c) 2020 Somebody. Public domain? Creative Commons Attribution 4.0 International",
        "cc by cc by cc by " * 300,
        "Kelvin K general public license İ",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    tables = [(docs, licenses(docs)), (spark.read.parquet(f"{sf}/documents.parquet"), QUERIES["op7_license_rules"](spark, sf)), (odd, licenses(odd))]
    for table, found in tables:
        want = sorted((brute_licenses(r.text) for r in table.collect()), key=str)
        assert sorted((tuple(r)[1:] for r in found.collect()), key=str) == want
    assert licenses(none).count() == 0
    assert len(STATEMENTS) + len(MENTIONS) > 250 and len({r[3] for r in rules()}) > 400


def examples(parsed):
    """Texts that a parsed pattern matches: each branch, and repeats at their least and once more; a part at a time."""
    found = [""]
    for op, x in parsed:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(x)]
        elif kind == "NOT_LITERAL":
            own = ["q"]
        elif kind == "IN":
            own = [chr(v[0] if str(o) == "RANGE" else v) if str(o) != "NEGATE" else "q" for o, v in x[:1]]
            own = own if str(x[0][0]) == "NEGATE" else [chr(v[0] if str(o) == "RANGE" else v) for o, v in x]
        elif kind == "BRANCH":
            own = [t for p in x[1] for t in examples(p)]
        elif kind == "SUBPATTERN":
            own = examples(x[3])
        else:
            assert kind == "MAX_REPEAT", kind
            least, most, inner = x
            own = [t * n for n in {least, min(most, least + 1)} for t in examples(inner)]
        found = [a + b for a in found for b in own]
    return found


def test_keyword_and_gate_hold_on_every_rule(spark):
    made = []
    for _, label, keyword, pattern, _ in rules():
        for t in examples(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, t), (label, t)
            assert keyword and keyword in f" {t} ", (label, keyword, t)
            made.append(t)
    for p in BASE:
        made.append(p)
    texts = spark.createDataFrame([(t,) for t in set(made)], "t string")
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    assert texts.withColumn("w", words).where(~gate(F.col("t"), F.col("w"))).collect() == []


def test_personal_use_and_copyright_sign(spark):
    texts = ["For personal use only.", "Copyright © 2020 Foo", "Copyright ©2020 Foo", "For personal use-only"]
    found = {r.doc_id: r.labels for r in licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: "non-commercial", 1: "copyright", 2: "copyright", 3: "non-commercial"}
