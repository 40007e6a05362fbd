from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.packing import BROOD, best_fit, cross, evolve, evolved, mutate, pack, pack_documents
from tessera.llm.queries import QUERIES


def check(rows, texts, length):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = [np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    want = collections.Counter()
    for x in ids:
        n = -(-len(x) // length)
        first = len(x) - (n - 1) * length
        for k in range(n):
            a, z = (0, first) if k == 0 else (first + (k - 1) * length, first + k * length)
            want[k, a, z - a, zlib.crc32(x[a:z].tobytes())] += 1
    assert collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= length
    return len(places), sum(map(len, ids))


def test_packing(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = check(QUERIES["op1_genetic_packing"](spark, sf).collect(), texts, 1024)
    assert n <= -(-total // 1024) + 2


def test_many_problems_and_odd_rows(spark, odd, none):
    texts = [f"word {i} " * (i % 23) for i in range(600)] + ["<|endoftext|> is text"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    n, total = check(pack(docs, length=64, problem=100).collect(), texts, 64)
    assert n <= 1.05 * total / 64 + 1
    check(pack(odd, length=16).collect(), [r.text for r in odd.collect()], 16)
    assert pack(none).count() == 0
    assert pack_documents(odd).agg({"tokens": "max"}).first()[0] <= 1024


def test_operators_keep_every_item():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 200).tolist()
    everything = list(range(200))
    a = best_fit(everything, sizes, [], 100)
    b = [[i] for i in everything]
    child = cross(b, a, sizes, 100, rng)
    for bins in (a, child, mutate(b, 20, sizes, 100, rng), evolve(sizes, 100, [b], 5, rng)[0]):
        assert sorted(i for x in bins for i in x) == everything
        assert all(sum(sizes[i] for i in x) <= 100 for x in bins)


def test_evolution_saves_bins(spark):
    """Sizes that best fit packs badly: a fifth or more of its bins above the bound must go."""
    for n, low, high, capacity in ((1000, 20, 101, 150), (500, 250, 500, 1000), (2000, 100, 700, 1024)):
        sizes = np.random.default_rng(n).integers(low, high, n).tolist()
        bound, start = -(-sum(sizes) // capacity), len(best_fit(list(range(n)), sizes, [], capacity))
        assert start >= bound + 3
        reached = len(evolve(sizes, capacity, [], BROOD, np.random.default_rng(1))[0])
        assert reached <= start - (start - bound) // 5 and reached < start
        items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
        assert evolved(items, 1, capacity, 2, 2, BROOD).select("bin").distinct().count() <= reached  # islands and migration


def test_very_long_runs_of_blanks(spark):
    texts = [" " * 2_000_000 + "a", "\n" * 1_000_000 + "b", "x y"]
    check(pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), texts, 1024)
