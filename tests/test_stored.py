from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.stored import Conflict, StoredTable, merged

def day(month):
    return F.expr(f"timestamp_ntz '2024-0{month}-01 00:00:00'")


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(60)], "id long, name string, level int")
    return StoredTable.create(rows, f"file://{tmp_path}/t", ["id"], 8, day(1))


def state(table, version=None):
    return {r.id: (r.name, r.level, r.updated_at.month) for r in table.read(version).collect()}


def change(spark, rows, schema="id long, name string, level int"):
    return spark.createDataFrame(rows, schema)


SET = {"name": "new.name", "level": "coalesce(new.level, old.level)"}


def test_only_touched_parts_are_rewritten(spark, table):
    before = table.at()["parts"]
    assert table.commit(change(spark, [(7, "seven", None), (600, "no", 1)]), merged(["id"], SET, at=day(2))) == 1
    after = table.at()["parts"]
    touched = {str(r[0]) for r in spark.range(1).select(F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(8))).union(spark.range(1).select(F.pmod(F.xxhash64(F.lit(600).cast("long")), F.lit(8)))).collect()}
    assert {k for k in before if before[k] != after.get(k)} == touched and len(touched) < len(before)
    assert state(table) == state(table, 0) | {7: ("seven", 1, 2)} and state(table, 0)[7] == ("n7", 1, 1)


def test_a_repeated_batch_changes_nothing(spark, table):
    add = merged(["id"], {"level": "old.level + 1"}, at=day(2))
    one = change(spark, [(1, None, None)])
    assert [table.commit(one, add, batch=b) for b in (4, 4, 3, 5)] == [1, 1, 1, 2]
    assert state(table)[1] == ("n1", 3, 2)


def test_a_killed_writer_leaves_the_old_version(spark, table, monkeypatch):
    was = state(table)
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.commit(change(spark, [(1, "x", 0)]), merged(["id"], SET, at=day(2)), batch=1)
    again = StoredTable(spark, table.folder)
    assert state(again) == was and again.versions() == [0]
    again.commit(change(spark, [(1, "x", 0)]), merged(["id"], SET, at=day(2)), batch=1)
    assert state(again) == was | {1: ("x", 0, 2)}
    again.vacuum(1)
    assert again.versions() == [1] and state(again) == was | {1: ("x", 0, 2)}
    assert {s.getPath().getName() for s in again._fs.listStatus(again._path("data"))} == {p.split("/")[1] for p in again.at()["parts"].values()}


def test_two_writers_both_count(spark, table):
    other, seen = StoredTable(spark, table.folder), []

    def meanwhile(old, changes):
        if not seen:  # another commit comes between this one's reading and its version
            seen.append(other.commit(change(spark, [(2, "other", 9)]), merged(["id"], SET, at=day(2))))
        return merged(["id"], {"level": "old.level + 10"}, at=day(2))(old, changes)

    assert table.commit(change(spark, [(2, None, None)]), meanwhile) == 2 and seen == [1]
    assert state(table)[2] == ("other", 19, 2)
    with pytest.raises(Conflict):
        table._publish(table.at())


@pytest.mark.parametrize("seed", range(2))
def test_changes_against_a_dictionary(spark, table, seed):
    r, want = random.Random(seed), state(table)
    for n in range(3):
        rows = {r.randrange(90): (f"c{n}", r.choice([None, 0, 1, 2])) for _ in range(25)}
        table.commit(change(spark, [(k, *v) for k, v in rows.items()]), merged(["id"], SET, when="old.level < 2", insert="new.level = 1", delete="new.level = 0", at=day(2)), batch=n)
        for k, (name, level) in rows.items():
            if k not in want:
                if level == 1:
                    want[k] = (name, level, 2)
            elif level == 0:
                del want[k]
            elif want[k][1] < 2:
                want[k] = (name, want[k][1] if level is None else level, 2)
    assert state(table) == want


def test_a_stream_into_a_table(spark, table, tmp_path):
    for n in range(3):
        change(spark, [(n, "s", 5), (100 + n, "s", 6)]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema("id long, name string, level int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    count = merged(["id"], {"name": "new.name", "level": "coalesce(old.level, 0) + new.level"}, insert="true", at=day(2))
    for ck in ("a", "a", "b"):  # a restart, and a lost checkpoint: all batches come again
        q = source.writeStream.foreachBatch(table.sink(count)).option("checkpointLocation", f"{tmp_path}/{ck}").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    got = state(table)
    assert len(got) == 63 and [got[k][1] for k in (0, 1, 2, 100, 101, 102)] == [5, 6, 7, 6, 6, 6] and table.versions() == [0, 1, 2, 3]


def test_a_table_without_rows(spark, tmp_path):
    table = StoredTable.create(change(spark, []), f"file://{tmp_path}/t", ["id"], 4)
    assert state(table) == {} and table.commit(change(spark, []), merged(["id"], SET)) == 1
    table.commit(change(spark, [(1, "a", 1)]), merged(["id"], SET, insert="true"))
    assert table.read().count() == 1
    table.commit(change(spark, [(1, None, None)]), merged(["id"], {}, delete="true"))
    assert table.read().count() == 0 and table.read(2).count() == 1
