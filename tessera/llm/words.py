"""Words of whole texts as flat arrays, for work that runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def texts(column: pa.Array) -> pa.Array:
    """Null becomes empty. Slices are copied: string functions read others' bytes where a slice doesn't start at 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) and (column.offset or np.frombuffer(column.buffers()[1], np.int64, 1)[0]):
        column = column.take(pa.array(np.arange(len(column))))
    return column


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z in lower case, one after another; and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts(column)))
    flat = lists.flatten()
    owner = pa.array(np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(lists))))  # right for slices too
    full = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():  # splitting leaves empty strings at the ends
        flat, owner = flat.filter(full), owner.filter(full)
    return flat, np.bincount(np.asarray(owner), minlength=len(column)).astype(np.int64)


def word_ids(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words, and the distinct words by number."""
    d = flat.dictionary_encode()
    return np.asarray(d.indices, np.int64), d.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one hold about `most` bytes; one longer text still comes whole."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)


def arrow_map(df, function: Callable[[pa.RecordBatch, int], pa.Table | pa.RecordBatch | None], schema: pa.Schema, ddl: str, text_column: int | None = None):
    """mapInArrow for a function of one batch and the number of its first row, which is unique in `df`."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in by_bytes(batches, text_column) if text_column is not None else batches:
            out = function(b, row)
            row += len(b)
            if out is not None and len(out):
                yield from pa.table(out).cast(schema).to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, ddl)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte whether it lies outside all the ranges, both ends included."""
    out = np.ones(256, bool)
    for a, z in ranges:
        out[a : z + 1] = False
    return out


def byte_words(column: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the bytes `inside`, A-Z in lower case: the words, one after another; the text of each; where each starts; and all bytes.

    Every byte from 0x80 on must be inside, so that runs of bytes are runs of characters."""
    column = texts(column).cast(pa.large_binary())
    if not len(column):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data, within = lower[data], inside[data]
    begins, ends = within.copy(), within.copy()
    begins[1:] &= ~within[:-1]
    ends[:-1] &= ~within[1:]
    full = np.diff(edges) > 0
    first, last = edges[:-1][full], edges[1:][full] - 1
    begins[first], ends[last] = within[first], within[last]
    at = np.flatnonzero(begins)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - at)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[within])])
    return flat, np.searchsorted(edges, at, "right") - 1, at, data


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes of text, from smaller or larger ones; one longer text still comes whole."""
    held, size = [], 0
    for b in by_bytes(batches, column, most):
        here = b.column(column).nbytes
        if held and size + here > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += here
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
