from __future__ import annotations

import pytest

from tessera.streaming.retries import drain, retried, settled

pytest.importorskip("google.protobuf")


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(spark, folder, pause=0.3):
    def handle(body, attempt):  # workers can't import this module
        if body == "bad" or body == "late" and attempt < 3:
            raise ValueError(f"no {attempt}")

    source = spark.readStream.schema("message_id long, body string").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    ends = retried(source, handle, pause=pause)
    return settled(ends, f"{folder}/out", f"{folder}/ck"), lambda: spark.read.schema(ends.schema).parquet(f"{folder}/out")


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "message_id long, body string").coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_one_bad_message_of_a_hundred(spark, tmp_path):
    put(spark, tmp_path, "a", [(i, {13: "bad", 14: "late", 15: None}.get(i, "good")) for i in range(100)])
    q, read = run(spark, tmp_path)
    drain(q, read, 100)
    rows = {r.message_id: (r.outcome, r.attempts, r.error) for r in read().collect()}
    assert len(rows) == 100 and rows[13] == ("dead", 3, "no 3") and rows[14] == ("stored", 3, None)
    assert all(r == ("stored", 1, None) for i, r in rows.items() if i not in (13, 14))
    assert spark.read.parquet(f"{tmp_path}/out/outcome=dead").count() == 1


def test_attempts_outlive_a_restart(spark, tmp_path):
    put(spark, tmp_path, "a", [(1, "bad"), (2, "good")])
    q, read = run(spark, tmp_path, pause=3)
    drain(q, read, 1)
    assert [r.message_id for r in read().collect()] == [2]
    put(spark, tmp_path, "b", [(1, "bad"), (3, "good")])  # 1 is delivered again while it waits
    q, read = run(spark, tmp_path, pause=0.2)
    drain(q, read, 3)
    assert sorted((r.message_id, r.outcome, r.attempts) for r in read().collect()) == [(1, "dead", 3), (2, "stored", 1), (3, "stored", 1)]


def test_long_batches_are_waited_for(spark, tmp_path):
    """The first batch takes longer than the limit, one message has no id, one is sent twice: all others meet their end."""

    def slow(body, attempt):
        import time

        time.sleep(0.3)
        if body == "late" and attempt < 2:
            raise ValueError("no")

    put(spark, tmp_path, "a", [(i, "late" if i % 10 == 3 else "good") for i in range(60)] + [(None, "good"), (3, "late")])
    source = spark.readStream.schema("message_id long, body string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ends = retried(source, slow, pause=0.2)
    drain(settled(ends, f"{tmp_path}/out", f"{tmp_path}/ck"), lambda: spark.read.schema(ends.schema).parquet(f"{tmp_path}/out"), limit=1.0)
    rows = spark.read.schema(ends.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.message_id, r.outcome, r.attempts) for r in rows) == [(i, "stored", 2 if i % 10 == 3 else 1) for i in range(60)]
    put(spark, tmp_path, "b", [(100, "good")])
    q = settled(ends, f"{tmp_path}/out", f"{tmp_path}/ck")
    with pytest.raises(TimeoutError):
        drain(q, lambda: spark.read.schema(ends.schema).parquet(f"{tmp_path}/out"), 62, limit=1.0)  # there are 61
