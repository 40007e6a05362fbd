"""Shards of nearly equal bytes that never split a group of equal texts.

Groups stand in the order of their text's hash. ATOMS hash ranges make up the ordered atomic sizes:
a group lies in one atom, and the atoms' number does not grow with the data, so their sizes fit the
driver. A binary search finds the smallest capacity at which a greedy scan needs no more than the
given number of shards; the cuts of that scan stand.

Edge cases: a null text has 0 bytes and equals the empty text in grouping; an empty table gives no
rows; with fewer groups than shards some shards stay empty; repeated rows each get a slot of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import save, text_or_empty

#: Hash ranges: 2 ** 18 longs on the driver, whatever the input.
ATOM_BITS = 18
#: Parts of an atom for numbering its rows: a text that a third of all rows share has that many tasks.
SALTS = 64
ROW_BYTES = 16


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """First atom of each shard, for the smallest largest shard of contiguous atoms."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0

    def scan(capacity: int) -> list[int] | None:
        starts, at, used = [0], 0, 0
        while used < total:
            at = int(np.searchsorted(ends, used + capacity, "right"))
            if at == len(ends) or used == int(ends[-1]):
                break
            if len(starts) == shards:
                return None
            starts.append(at)
            used = int(ends[at - 1])
        return starts

    low, high = max(int(sizes.max(initial=0)), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        if scan(mid) is None:
            low = mid + 1
        else:
            high = mid
    found = scan(low) or [0]
    return np.array(found + [len(sizes)] * (shards - len(found)), np.int64)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    text = text_or_empty(text_col)
    keyed = save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("digest"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
        ).withColumn("atom", F.expr(f"cast(conv(substr(digest, 1, 5), 16, 10) as int) div {1 << (20 - ATOM_BITS)}").cast("int")),
        "shard",
    )
    sizes = np.zeros(1 << ATOM_BITS, np.int64)
    for atom, size in keyed.groupBy("atom").agg(F.sum("size")).toPandas().itertuples(index=False):  # at most 2 ** ATOM_BITS rows
        sizes[atom] = size
    cuts = minimax_cuts(sizes, shards)
    of_atom = F.aggregate(F.array(*[F.lit(int(c)) for c in cuts[1:]]), F.lit(0), lambda n, c: n + (F.col("atom") >= c).cast("int"))
    cells = keyed.groupBy("atom", "salt").agg(F.count("*").alias("n")).withColumn("shard", of_atom)
    before = Window.partitionBy("shard").orderBy("atom", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("atom", "salt").orderBy("digest", "doc_id")
    return keyed.join(cells, ["atom", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(own) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
