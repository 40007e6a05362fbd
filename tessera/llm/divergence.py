"""How far each source's words are from those of the other sources of its language, in exact integers.

Texts are read once. A task counts the cells (language, source, term) of about 4 MB of text at a time
by numbers: terms get dictionary numbers, cells are counted by them, and only then leave as strings.
A longer text is taken apart in such parts, whose counts are added up before it counts as one document.
Cells are summed and dealt by ranges of (language, term), sorted. So each task sees every cell of its
terms in UTF-8 order and cuts them into chunks: a chunk has the sorted array of its kept terms, ids
that searchsorted finds in it, and a dense matrix of counts, a row a source, that bincount fills. Ids
count on from chunk to chunk in UTF-8 order, so ties fall to the lesser id. A chunk has at most CELLS
cells whatever the number of sources; nothing but one chunk, the sums over pairs of one language's
sources and each source's first TOP terms is in a task's memory, and no dictionary is sent to tasks.

All sums are 64-bit integers. A share is found by long division, three digits at a time, which is
exact while a language has fewer than 9e15 occurrences.

Edge cases: a null text, language or source counts as ''; a text without terms, an empty one too,
still makes its source a group; a language that keeps no term has pairs of value 0 and no terms; a
language with one source has no pairs; repeated rows and rows without an id are documents of their
own; a very long text is read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, small_batches
from tessera.llm.words import byte_table, byte_words, gathered

IN_TERM = byte_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes of text that a task takes apart at a time; its arrays take some 25 times as much memory.
GATHERED = 4 << 20
#: Chunks are dealt to one audit a language for each so many cells of all of them.
CELLS = AUDITED = 1 << 20
#: Cells of sorted terms that a task holds before it cuts chunks.
HELD = 1 << 18
LEAST_DOCS, TOP = 3, 200


def or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(text: pa.Buffer, most: int) -> Iterator[pa.Array]:
    """A text in parts of less than twice `most` bytes, cut behind bytes outside terms; a longer term stays whole."""
    data, at, seen = np.frombuffer(text, np.uint8), 0, 0
    while at < len(data):
        outside = np.flatnonzero(~IN_TERM[data[seen : seen + most]])
        end = seen + int(outside[-1]) + 1 if len(outside) else 0
        seen += most
        if seen >= len(data):
            end = len(data)
        if end:
            yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, end - at])), text.slice(at, end - at))
            at = end


def term_counts(text: pa.Buffer, most: int) -> pa.Table:
    """(term, n) of one long text."""
    merged = lambda held: pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("n", "sum")]).select(["term", "n_sum"]).rename_columns(["term", "n"])
    held = []
    for part in parts(text, most):
        found = byte_words(part, IN_TERM)[0].value_counts()
        held.append(pa.table({"term": found.field(0), "n": found.field(1)}))
        if len(held) > 8:
            held = [merged(held)]
    return merged(held)


def term_cells(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, docs, n): documents with the term and its occurrences, a row a cell."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])

    def rows(lang: pa.Array, source: pa.Array, term: pa.Array, docs_in: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = [x.cast(pa.string()) for x in (lang, source, term.cast(pa.large_string()))]
        yield from pa.table([*names, pa.array(docs_in.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema).to_batches(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in gathered(batches, 2, GATHERED):
            long = np.asarray(pc.fill_null(pc.binary_length(b.column(2)), 0)) > GATHERED
            for i in np.flatnonzero(long).tolist():
                found = term_counts(b.column(2)[i].as_buffer(), GATHERED)
                same = pa.array(np.full(len(found), i))
                yield from rows(b.column(0).take(same), b.column(1).take(same), found.column("term").combine_chunks(), np.ones(len(found)), np.asarray(found.column("n")))
            if long.any():
                b = b.filter(pa.array(~long))
            flat, owner = byte_words(b.column(2), IN_TERM)[:2]
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            d = max(1, len(coded.dictionary))
            pairs, n = np.unique(owner * d + np.asarray(coded.indices, np.int64), return_counts=True)  # (document, term)
            del flat, owner
            lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
            group = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices, np.int64)
            cells, at, docs_in = np.unique(group[pairs // d] * d + pairs % d, return_inverse=True, return_counts=True)
            total = np.bincount(at, n)
            group, term = cells // d, cells % d
            yield from rows(lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), coded.dictionary.take(pa.array(term)), docs_in, total)

    found = docs.select(or_empty(lang_col), or_empty(source_col), F.col(text_col).cast("string")).mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def term_chunks(cells: DataFrame) -> DataFrame:
    """(lang, chunk, terms, sources, counts): kept terms in UTF-8 order, the sources with any of them, and the counts, a row a source."""
    ddl = "lang string, chunk long, terms array<string>, sources array<string>, sums array<long>, counts binary"
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("counts", pa.binary())])

    def chunks_of(table: pa.Table, chunk: int) -> Iterator[tuple]:
        """Of sorted cells of one language."""
        terms, docs, n = table.column("term").combine_chunks(), np.asarray(table.column("docs")), np.asarray(table.column("n"))
        run = np.asarray(pc.run_end_encode(terms).run_ends, np.int64)
        first = np.concatenate([[0], run[:-1]])
        kept = np.flatnonzero(np.add.reduceat(docs, first) >= LEAST_DOCS)
        number = np.repeat(np.arange(len(run)), run - first)  # of each cell's term, in UTF-8 order
        sources = table.column("source").combine_chunks().dictionary_encode()
        of_source, wide = np.asarray(sources.indices, np.int64), max(1, CELLS // len(sources.dictionary))
        for a in range(0, len(kept), wide):
            ids = kept[a : a + wide]
            lo, hi = first[ids[0]], run[ids[-1]]
            at = np.searchsorted(ids, number[lo:hi])
            on = ids[np.minimum(at, len(ids) - 1)] == number[lo:hi]
            here, row = np.unique(of_source[lo:hi][on], return_inverse=True)
            counts = np.bincount(row * len(ids) + at[on], n[lo:hi][on], len(here) * len(ids)).astype(np.int64).reshape(len(here), -1)
            yield table.column("lang")[0].as_py(), chunk, terms.take(pa.array(first[ids])).to_pylist(), sources.dictionary.take(pa.array(here)).to_pylist(), counts.sum(1).tolist(), counts.tobytes()
            chunk += 1

    def by_lang(table: pa.Table) -> Iterator[pa.Table]:
        at = 0
        for end in pc.run_end_encode(table.column("lang").combine_chunks()).run_ends.to_pylist():
            yield table.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def cut(table: pa.Table):
            nonlocal chunk
            for part in by_lang(table):
                for row in chunks_of(part, chunk):
                    chunk = row[1] + 1
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= HELD:
                table = pa.Table.from_batches(held)
                last = table.slice(size - 1)
                back, lang, term = size - 1, last.column("lang")[0], last.column("term")[0]
                langs, terms = table.column("lang"), table.column("term")
                while back and terms[back - 1] == term and langs[back - 1] == lang:  # a term has a cell a source at most
                    back -= 1
                yield from cut(table.slice(0, back))
                held = table.slice(back).to_batches()
                size -= back
        if size:
            yield from cut(pa.Table.from_batches(held))

    ranged = cells.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ranged.select("lang", "source", "term", "docs", "n").mapInArrow(run, ddl)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (counts + 1) / total), exactly."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Audit:
    """Sums over the chunks of one language that a task has seen."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], kept: int) -> None:
        self.lang, self.sources = lang, sources
        self.row = {s: i for i, s in enumerate(sources)}
        self.total = np.array(totals, np.int64)[:, None] + kept
        self.all = np.array([sum(totals) + kept], np.int64)
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.terms: list[list[tuple]] = [[] for _ in sources]

    def add(self, chunk: int, terms: list[str], sources: list[str], counts: np.ndarray) -> None:
        seen = [self.row[s] for s in sources]
        every = np.zeros((len(self.sources), len(terms)), np.int64)
        every[seen] = counts
        p = shares(every, self.total)
        q = shares(counts.sum(0), self.all)
        for g in range(len(p)):
            self.pairs[g] += gaps(p[g], p).sum(1)
        for g in seen:
            on = np.flatnonzero((every[g] > 0) & (p[g] > q))
            value = gaps(p[g][on], q[on])
            best = np.lexsort((on, -value))[:TOP]
            self.terms[g] += [(-int(v), chunk, int(i), terms[i]) for v, i in zip(value[best], on[best], strict=True)]
            if len(self.terms[g]) > 4 * TOP:
                self.terms[g] = sorted(self.terms[g])[:TOP]

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value", "chunk", "id"]
        kinds = [pa.string()] * 4 + [pa.int64()] * 3
        for g, source in enumerate(self.sources):
            found = [(self.lang, source, "pair", other, int(self.pairs[g, h]), 0, 0) for h, other in enumerate(self.sources) if g != h]
            found += [(self.lang, source, "term", term, -v, chunk, i) for v, chunk, i, term in sorted(self.terms[g])[:TOP]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def audited(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, chunk, id): partial sums of pairs, and each task's first terms of a source."""
    totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("n"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    whole = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all")).join(sizes, "lang")
    cells = chunks.agg(F.sum(F.size("terms") * F.size("sources").cast("long"))).first()[0] or 0
    chunks = chunks.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(-(-cells // AUDITED) or 1)))  # so that no task gets a whole language
    of_block = chunks.select("lang", "block").distinct().join(whole, "lang")

    def run(batches: Iterator[pa.RecordBatch]):
        audit = None
        for b in batches:
            for r in b.to_pylist():
                if audit is None or audit.lang != r["lang"]:
                    if audit:
                        yield from audit.rows()
                    audit = Audit(r["lang"], [x["source"] for x in r["all"]], [x["n"] for x in r["all"]], r["kept"])
                audit.add(r["chunk"], r["terms"], r["sources"], np.frombuffer(r["counts"], np.int64).reshape(len(r["sources"]), -1))
        if audit:
            yield from audit.rows()

    return chunks.join(of_block, ["lang", "block"]).sortWithinPartitions("lang").mapInArrow(run, "lang string, source string, part string, item string, value long, chunk long, id long")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (the other source, or the term), value, rank."""
    small_batches(docs.sparkSession)
    cells = save(term_cells(docs, text_col, lang_col, source_col), "cells")
    chunks = save(term_chunks(cells), "chunks")
    groups = save(docs.select(or_empty(lang_col).alias("lang"), or_empty(source_col).alias("source")).distinct(), "groups")
    found = save(audited(chunks, groups), "audit")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    w = Window.partitionBy("lang", "source")
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), "item")))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), "chunk", "id"))).where(f"rank <= {TOP}")
    return ranked.unionByName(terms.select(*ranked.columns))
