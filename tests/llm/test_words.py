from __future__ import annotations

import re

import pyarrow as pa

from tessera.llm.words import by_bytes, split_words


def test_words_of_slices():
    found = ["Ab  c\n", None, "", " x\x0by ", "É é", "z" * 50] * 4
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in found]
    for column in (pa.array(found), pa.array(found, pa.large_string())):
        for a in range(len(found)):
            flat, counts = split_words(column.slice(a, 7))
            assert flat.to_pylist() == [w for ws in want[a : a + 7] for w in ws] and counts.tolist() == [len(ws) for ws in want[a : a + 7]]


def test_cuts_by_bytes():
    batch = pa.record_batch({"t": ["a" * 10] * 10 + [None, "b" * 100]})
    parts = list(by_bytes(iter([batch]), 0, 25))
    assert len(parts) > 3 and pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
