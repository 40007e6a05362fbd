"""Phrases whose words stand together more often than apart, mined by pivot partitioning.

Three passes. The first counts words by language, exactly, into a table. From the words with LEAST
occurrences or more it makes a table of CELLS cells, the largest count of the words that hash to a
cell: that is all a task needs to put words in order of rarity, and its size doesn't depend on the
corpus. Two words in a cell take their order from their hashes; any order that all tasks agree on
gives right counts, since the rarest word, the pivot, only decides who counts a phrase.

The second pass rewrites text into fragments. For each place of a word it keeps the neighbours that a
phrase with this word as pivot can have: those in the piece, on either side, up to the first that is
rarer (of equal words the leftmost is the pivot) or too rare for any phrase; all else is blank.
Fragments are summed by task, dealt by pivot, and mined where they arrive: each of their phrases is
owned by the pivot, so no other task has any of its occurrences. Pivots with more than one
HOT-th of all words are dealt to SALTS tasks each, and their sums are added once more.

The third pass joins phrases with words and with the shorter phrases in them. Words travel as 64-bit
hashes of language and word; the table of words shows whether two words share a hash, and if so all
is done again with another seed. Scores are decimals without fraction, exact up to 10 ** 15 words.

Edge cases: a null text is empty, a null language `und`; a text without words counts nothing; repeated
rows and rows without an id count like others; a very long text is read whole; a language with fewer
than TOP candidates gives them all, one without candidates no rows; ties in score and count fall to the
lesser phrase in UTF-8 order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, small_batches
from tessera.llm.words import byte_table, byte_words, gathered

LEAST, SHARE, TOP = 10, 50, 2000
CELLS = 1 << 21
HOT, SALTS = 4096, 64
BREAKS = b".,;:!?\n\x0b\x0c\r"
IN_WORD = byte_table((0x09, 0x0D), (0x20, 0x20), *[(b, b) for b in BREAKS])
IS_BREAK = ~byte_table(*[(b, b) for b in BREAKS])
LANG = "und"


class Tokens:
    """The words of a batch (lang, text): number of each word in place, whether the next word follows it in its piece, and by number language and word."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        flat, owner, at, data = byte_words(batch.column(1), IN_WORD)
        langs, words = batch.column(0).dictionary_encode(), flat.dictionary_encode()
        lang, size = np.asarray(langs.indices, np.int64), max(1, len(words.dictionary))
        self.number, both = pd.factorize(lang[owner] * size + np.asarray(words.indices, np.int64))
        self.lang, self.word = langs.dictionary.take(pa.array(both // size)), words.dictionary.take(pa.array(both % size))
        piece = np.cumsum(IS_BREAK[data], dtype=np.int64)[at]
        self.follows = np.zeros(len(at), bool)
        self.follows[:-1] = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])

    def hashes(self, seed: int) -> np.ndarray:
        """By number; never 0, which stands for a blank."""
        h = xxhash.xxh3_64_intdigest
        marks = {x: len(b).to_bytes(4, "little") + b for x in self.lang.unique().to_pylist() for b in [x.encode()]}
        return np.fromiter((h(marks[x] + w, seed) or 1 for x, w in zip(self.lang.to_pylist(), self.word.to_pylist(), strict=True)), np.uint64, len(self.word))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(docs: DataFrame, seed: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, h, n), a row a word of a language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in gathered(batches, 1):
            t = Tokens(b)
            n = np.bincount(t.number, minlength=len(t.word)).astype(np.int64)
            yield from pa.table([t.lang.cast(pa.string()), t.word.cast(pa.string()), pa.array(t.hashes(seed).view(np.int64)), pa.array(n)], schema=schema).to_batches(1 << 16)

    found = _texts(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, h long, n long")
    return found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def cell_counts(words: DataFrame) -> np.ndarray:
    """By cell the largest count of its words; counts over 2 ** 32 are alike."""
    found = words.groupBy(F.expr(f"h & {CELLS - 1}").alias("cell")).agg(F.max(F.least("n", F.lit(2**32 - 1))).alias("n")).toArrow()
    out = np.zeros(CELLS, np.uint32)
    out[np.asarray(found.column("cell"), np.int64)] = np.asarray(found.column("n")).astype(np.uint32)
    return out


def numbered(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct rows, and the first row of each; all values lie below `size`."""
    key, top = columns[0], size
    for c in columns[1:]:
        if top * size >= 1 << 62:
            key, found = pd.factorize(key)
            top = len(found)
        key, top = key * size + c, top * size
    codes, found = pd.factorize(key)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def rewritten(number: np.ndarray, follows: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Fragments (pivot, left, left of it, right, right of it) as numbers plus 1, 0 for a blank. rank: by number, lowest for the rarest word, -1 for words of no phrase."""
    r = rank[number]
    near = lambda x, k: np.concatenate([x[k:], np.full(k, x.dtype.type(-1))]) if k > 0 else np.concatenate([np.full(-k, x.dtype.type(-1)), x[:k]])
    linked = follows & (r >= 0)
    linked[:-1] &= r[1:] >= 0
    link = linked.astype(np.int8)
    left1 = (near(link, -1) == 1) & (near(r, -1) > r)
    left2 = left1 & (near(link, -2) == 1) & (near(r, -2) > r)
    right1 = linked & (near(r, 1) >= r)
    right2 = right1 & (near(link, 1) == 1) & (near(r, 2) >= r)
    at = np.flatnonzero(left1 | right1)
    word = number + 1
    return [word[at], *[np.where(on[at], word[(at + k).clip(0, len(word) - 1)], 0) for on, k in ((left1, -1), (left2, -2), (right1, 1), (right2, 2))]]


def fragments(docs: DataFrame, seed: int, cells: np.ndarray, total: int, text_col: str, lang_col: str) -> DataFrame:
    """(p, salt, l1, l2, r1, r2, n): rewritten fragments by pivot; salt is 0 but for hot pivots."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    names = ["p", "salt", "l1", "l2", "r1", "r2", "n"]

    def run(batches: Iterator[pa.RecordBatch]):
        counts = shared.value
        for b in gathered(batches, 1):
            t = Tokens(b)
            h = t.hashes(seed)
            n = counts[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.int64)
            rank = np.empty(len(h), np.int64)
            rank[np.lexsort((h, n))] = np.arange(len(h))
            rank[n == 0] = -1
            parts = rewritten(t.number, t.follows, rank)
            if not len(parts[0]):
                continue
            codes, first = numbered(parts, len(h) + 1)
            many = np.bincount(codes).astype(np.int64)
            of = np.concatenate([[0], h.view(np.int64)])
            p, l1, l2, r1, r2 = (of[x[first]] for x in parts)
            salt = np.where(n[parts[0][first] - 1] * HOT > total, 1 + ((l1 ^ (l2 * 3) ^ (r1 * 5) ^ (r2 * 7)) & (SALTS - 1)), 0)
            table = pa.table([pa.array(x) for x in (p, salt, l1, l2, r1, r2, many)], names=names)
            yield from table.to_batches(1 << 16)

    return _texts(docs, text_col, lang_col).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def phrases(frags: DataFrame, least: int) -> DataFrame:
    """(x, y, z, a): phrases of two words (z = 0) or three and their counts, from `least` on."""
    owned = F.expr(
        "inline(array(struct(l1 as x, if(l1 = 0, 0L, p) as y, 0L as z), struct(p as x, r1 as y, 0L as z), struct(l2 as x, if(l2 = 0, 0L, l1) as y, p as z),"
        " struct(l1 as x, if(l1 = 0 or r1 = 0, 0L, p) as y, r1 as z), struct(p as x, if(r2 = 0, 0L, r1) as y, r2 as z)))"
    )
    mined = frags.repartition("p", "salt").select("p", "salt", "n", owned).where("x <> 0 and y <> 0")
    local = mined.groupBy("p", "salt", "x", "y", "z").agg(F.sum("n").alias("a")).where(f"salt > 0 or a >= {least}")
    return local.groupBy("x", "y", "z").agg(F.sum("a").alias("a")).where(f"a >= {least}")


def scored(found: DataFrame, words: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate explains."""
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    score = lambda a, left, right: F.expr(f"cast((cast(1000000 as decimal(7, 0)) * {whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)}) as long)")
    first = words.select(F.col("h").alias("x"), "lang", F.col("word").alias("wx"), F.col("n").alias("fx"))
    second = words.select(F.col("h").alias("y"), F.col("word").alias("wy"), F.col("n").alias("fy"))
    two = save(found.where("z = 0").select("x", "y", "a").join(first, "x").join(second, "y"), "two")
    head = two.select("x", "y", "lang", "wx", "wy", "fx", F.col("a").alias("fxy"))
    tail = two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("wy").alias("wz"), F.col("fy").alias("fz"), F.col("a").alias("fyz"))
    three = save(found.where("z <> 0").join(head, ["x", "y"]).join(tail, ["y", "z"]), "three")
    longer = three.select("x", "y", "a").unionAll(three.select("y", "z", "a").toDF("x", "y", "a")).groupBy("x", "y").agg(F.max("a").alias("longer"))
    left = two.join(longer, ["x", "y"], "left").where(f"longer is null or 100 * longer < {share} * a")
    pairs = left.select("lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), score("a", "fx", "fy").alias("score"))
    cuts = three.withColumn("s1", score("a", "fx", "fyz")).withColumn("s2", score("a", "fxy", "fz"))
    one = "s1 <= s2"
    triples = cuts.select("lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), "a", F.expr(f"if({one}, fx, fxy)").alias("l"), F.expr(f"if({one}, fyz, fz)").alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.unionAll(triples)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    small_batches(docs.sparkSession)
    for seed in range(100):
        words = save(word_counts(docs, seed, text_col, lang_col), "words")
        if words.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    able = words.where(F.col("n") >= least)
    total = words.agg(F.sum("n")).first()[0] or 0
    found = save(phrases(fragments(docs, seed, cell_counts(able), total, text_col, lang_col), least), "phrases")
    ranked = scored(found, able, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):  # so that no task sorts a whole language
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
