"""Exact deduplication by Grace hashing.

Two passes share one table of groups. The map pass collapses the copies inside each input
partition, so that a text which a third of all rows repeat leaves a partition once. The reduce
pass gathers what is left by content hash. Both partition their records to spill files, again and
again with further bits of the hash, until the distinct contents of a bucket fit an open-addressing
table that compares complete contents.

Edge cases: a null text equals the empty text; a null doc_id sorts below all others; rows that share
text and doc_id are copies like any others, exactly one of them stays; rows that share a doc_id alone
are apart; a text longer than the table's budget is still compared whole; an empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, keep_keys, save, small_batches

#: Bytes of distinct contents that one table may hold before its records go to spill files.
TABLE_BYTES = 96 << 20
FANOUT_BITS = 4
NO_ID = -(2**63)


class ContentTable:
    """Open addressing with linear probing; a hit needs equal complete contents."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.payload: list = []
        self.bytes = 0

    def find(self, key: int, content: bytes) -> tuple[int, bool]:
        """The number of the content's entry, and whether it is new."""
        mask = len(self.slots) - 1
        at = key & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == key and self.contents[e] == content:
                return int(e), False
            at = (at + 1) & mask
        e = len(self.contents)
        self.slots[at] = e
        self.hashes.append(key)
        self.contents.append(content)
        self.payload.append(None)
        self.bytes += len(content) + 200
        if 2 * (e + 1) > len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def grace(records: Iterator[tuple[int, bytes, object]], open_, fold, budget: int = TABLE_BYTES, grows: int = 0, level: int = 0) -> Iterator[tuple]:
    """Groups (hash, content, row) records by complete content.

    open_() makes a new group's state, fold(state, row) changes it and returns what the row gives at
    once. Yields (None, that) for each row and, at the end, (content, state) for each group. Memory:
    `budget` and one record, with `grows` bytes counted for a row folded in."""
    table = ContentTable()
    for key, content, row, state in ((*r, None) if len(r) == 3 else r for r in records):
        e, fresh = table.find(key, content)
        if fresh:
            table.payload[e] = state or open_()
        if not state:
            table.bytes += grows
            yield None, fold(table.payload[e], row)
        if table.bytes > budget and len(table.contents) > 1 and level * FANOUT_BITS < 64:
            break
    else:
        yield from zip(table.contents, table.payload, strict=True)
        return
    with tempfile.TemporaryDirectory() as folder:  # the task's own scratch space, gone when it ends
        names = [os.path.join(folder, str(i)) for i in range(1 << FANOUT_BITS)]
        files = [open(n, "wb") for n in names]  # noqa: SIM115
        shift, mask = 64 - FANOUT_BITS * (level + 1), (1 << FANOUT_BITS) - 1
        for key, content, state in zip(table.hashes, table.contents, table.payload, strict=True):
            pickle.dump((key, content, None, state), files[(key >> shift) & mask], protocol=5)
        del table
        for r in records:
            pickle.dump(r if len(r) == 4 else (*r, None), files[(r[0] >> shift) & mask], protocol=5)
        for f in files:
            f.close()

        def again(name: str) -> Iterator[tuple]:
            with open(name, "rb") as f:
                while True:
                    try:
                        yield pickle.load(f)
                    except EOFError:
                        return

        for name in names:
            yield from grace(again(name), open_, fold, budget, grows, level + 1)
            os.unlink(name)


def _key(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


def _collapse(budget: int):
    """Map pass: a row for each document, given out at once (its group's number here), and a row for each group."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("top_id", pa.int64()), ("top_uid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        numbers = itertools.count(base)

        def records():
            uid = base
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    content = (text.as_py() or "").encode().lower()
                    yield _key(content), content, (NO_ID if doc_id is None else doc_id, uid)
                    uid += 1

        def fold(state: list, row: tuple[int, int]) -> tuple:
            state[0] += 1
            state[1] = max(state[1], row)
            return row[1], row[0], state[2], None, None, None, None

        def rows():
            for content, state in grace(records(), lambda: [0, (NO_ID, -1), next(numbers)], fold, budget):
                yield state if content is None else (None, None, state[2], content, state[0], *state[1])

        yield from _batches(rows(), schema)

    return run, "uid long, doc_id long, rep long, content binary, n long, top_id long, top_uid long"


def _merge(budget: int):
    """Reduce pass: for each group number of the map pass, the row that stays and the size.

    A text has one such number for each task of the map pass that met it, 8 bytes each."""
    schema = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                rest = [b.column(k).to_pylist() for k in (0, 2, 3, 4)]
                for content, rep, n, i, uid in zip(b.column(1), *rest, strict=True):
                    content = content.as_py()
                    yield _key(content), content, (n, (i, uid), rep)

        def fold(state: list, row: tuple) -> None:
            state[0] += row[0]
            state[1] = max(state[1], row[1])
            state[2].append(row[2])

        def rows():
            for content, state in grace(records(), lambda: [0, (NO_ID, -1), array("q")], fold, budget, grows=8):
                if content is not None:
                    sha = hashlib.sha256(content).hexdigest()
                    for rep in state[2]:
                        yield rep, *state[1], state[0], sha

        yield from _batches(rows(), schema)

    return run, "rep long, keep_id long, keep_uid long, group_size long, text_sha256 string"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; the row with the largest doc_id stays.
    """
    small_batches(docs.sparkSession)
    run, schema = _collapse(table_bytes)
    first = save(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema), "exact")
    run, schema = _merge(table_bytes)
    groups = (
        first.where("content is not null")
        .select("rep", "content", "n", "top_id", "top_uid")
        .repartition(F.xxhash64("content"))
        .select("rep", "content", "n", "top_id", "top_uid")
        .mapInArrow(run, schema)
    )
    members = first.where("content is null").select("uid", "doc_id", "rep")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return members.join(groups, "rep").select(
        real("doc_id").alias("doc_id"), real("keep_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each group of equal texts exactly one.

    A row is found again by its doc_id and its normalised text together; of several such rows one stays."""
    key = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    kept = exact_groups(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return keep_keys(docs, key(F.col(id_col).cast("long"), F.sha2(folded, 256)), kept)
