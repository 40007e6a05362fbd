from __future__ import annotations

import random

import pytest

from tessera.operators.chunks import recursive_chunks, section_chunks


def brute(text, size, overlap, marks=("\n\n", "\n", " ", "")):
    """Word for word: split at the first mark present, keep marks at the head of parts, join what is short, split again what isn't."""
    mark = next(m for m in marks if m in text)
    finer = marks[marks.index(mark) + 1 :]
    if mark:
        at, parts = 0, []
        while (k := text.find(mark, at + (len(mark) if parts or text.startswith(mark) and at == 0 and parts else 0))) >= 0 and k < len(text):
            parts.append(text[at:k])
            at = k
            nxt = text.find(mark, at + len(mark))
            if nxt < 0:
                break
        parts.append(text[at:])
        parts = [p for p in parts if p]
    else:
        parts = list(text)
    out, short = [], []

    def flush():
        window: list[str] = []
        for p in short:
            if sum(map(len, window)) + len(p) > size:
                if window:
                    out.append("".join(window))
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        if window:
            out.append("".join(window))
        short.clear()

    for p in parts:
        if len(p) < size:
            short.append(p)
        else:
            flush()
            out.extend(brute(p, size, overlap, finer) if finer else [p])
    flush()
    return out


@pytest.mark.parametrize("seed", range(300))
def test_recursion_against_brute_force(seed):
    r = random.Random(seed)
    bits = ["a", "bb", "ccc", "x" * r.randrange(1, 40), " ", " ", " ", "\n", "\n\n", "\n\n\n", "\t", "é😀"]
    text = "".join(r.choice(bits) for _ in range(r.randrange(0, 120)))
    size, overlap = r.randrange(2, 40), r.randrange(0, 12)
    overlap = min(overlap, size - 1)
    want = [c.strip() for c in brute(text, size, overlap)] if text else []
    got = list(recursive_chunks(text, size, overlap))
    assert got == [c for c in want if c] and all(len(c) <= size for c in got)


def test_known_cuts():
    assert list(recursive_chunks(None)) == list(recursive_chunks("  \n ")) == []
    assert list(recursive_chunks("one two three four", 9, 4)) == ["one two", "two three"[4:], "four"]
    assert list(recursive_chunks("aa bb\n\ncc dd ee ff", 8, 0)) == ["aa bb", "cc dd", "ee ff"]
    assert list(recursive_chunks("abcdefghij", 4, 1)) == ["abcd", "defg", "ghij"]
    assert len(list(recursive_chunks("word " * 500_000))) > 2500


def test_sections_of_files(spark):
    text = "intro\n# Rules\n" + "the king moves one step. " * 60 + "\n## Castling\nonce\n### Long\nqueen side\n# End\nbye"
    rows = section_chunks(spark.createDataFrame([("a.md", text), ("b.md", ""), ("c.md", None)], "source string, text string"), 300, 30).orderBy("source", "position").collect()
    assert {r.source for r in rows} == {"a.md"} and [r.position for r in rows] == list(range(len(rows))) and all(len(r.chunk) <= 300 for r in rows)
    heads = [tuple(r.metadata) for r in rows]
    assert heads[0] == ("a.md", None, None, None) and ("a.md", "Rules", "Castling", "Long") in heads and heads[-1] == ("a.md", "End", None, None)
    assert rows[1].chunk.startswith("[Rules]") and rows[-2].chunk == "[Rules > Castling > Long]\n### Long\nqueen side"
