from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from tessera.streaming.rooms import COLUMNS, LOG, fold, room_stream

ACTIONS = ["create", "join", "join", "leave", "switch", "ready", "ready", "ready", "unready", "move", "move", "move", "resign", "offer_draw", "accept_draw", "decline_draw", "drop", "start"]


def log_row(room, n, at, user, action, role=None, **more):
    base = dict.fromkeys(COLUMNS) | {"room_id": room, "event_id": n, "at_ms": at, "user_id": user, "action": action, "role": role, "online": True, "busy": False}
    return tuple((base | more)[c] for c in COLUMNS)


def played(spark, rows):
    return fold(spark.createDataFrame(rows, LOG)).orderBy("room_id", "at_ms", "event_id").collect()


def test_game_to_timeout(spark):
    rows = [
        log_row(1, 1, 0, 10, "join", "white"),
        log_row(1, 2, 10, 10, "create", "white", time_minutes=1, increment_seconds=2),
        log_row(1, 3, 20, 11, "join", "white"),
        log_row(1, 4, 30, 11, "join", "black"),
        log_row(1, 5, 40, 12, "join", "spectator"),
        log_row(1, 6, 50, 12, "ready"),
        log_row(1, 7, 60, 10, "ready"),
        log_row(1, 8, 1000, 11, "ready"),
        log_row(1, 9, 2000, 10, "move"),
        log_row(1, 10, 5000, 11, "move"),
        log_row(1, 11, 6000, 10, "move"),
        log_row(1, 12, 9000, 11, "drop"),
        log_row(1, 13, 9500, 11, "leave"),
        log_row(1, 14, 70_000, 11, "move"),
        log_row(1, 15, 71_000, 10, "leave"),
        log_row(1, 16, 72_000, 11, "leave"),
        log_row(1, 17, 73_000, 12, "leave"),
        log_row(1, 18, 74_000, 12, "leave"),
    ]
    out = played(spark, rows)
    by = {r.event_id: r for r in out if r.event_id}
    assert [by[k].code for k in range(1, 19)] == [-1, 1, -4, 1, 1, -12, 1, 1, -16, -15, 1, 1, -18, -17, 1, 1, 1, -1]
    assert (by[11].white_ms, by[11].turn, by[11].ply, by[12].grace_ms) == (60_000, "black", 1, 57_000)
    assert [(r.action, r.at_ms, r.result) for r in out if r.event_id is None] == [("start", 4000, None), ("timeout", 66_000, "WHITE_WIN")]
    assert [(by[k].note, by[k].host_id) for k in (15, 16, 17)] == [("HOST_TRANSFERRED", 11), ("HOST_TRANSFERRED", 12), ("ROOM_EMPTY", None)]


def test_draws_and_seats(spark):
    ready = [log_row(2, 1, 0, 1, "create", "white"), log_row(2, 2, 1, 2, "join", "black"), log_row(2, 3, 2, 1, "ready"), log_row(2, 4, 3, 2, "ready")]
    more = [
        log_row(2, 5, 4, 2, "unready"),
        log_row(2, 6, 5, 2, "ready"),
        log_row(2, 7, 6, 1, "start"),
        log_row(2, 8, 3005, 1, "start"),
        log_row(2, 9, 4000, 1, "offer_draw"),
        log_row(2, 10, 5000, 2, "offer_draw"),
        log_row(2, 11, 6000, 1, "accept_draw"),
        log_row(2, 12, 7000, 2, "accept_draw"),
        log_row(2, 13, 8000, 2, "offer_draw"),
        log_row(2, 14, 38_000, 1, "accept_draw"),
        log_row(2, 15, 39_000, 2, "offer_draw"),
        log_row(2, 16, 40_000, 1, "accept_draw"),
        log_row(2, 17, 41_000, 1, "switch", "black"),
        log_row(2, 18, 41_001, 1, "switch", "white"),
        log_row(2, 19, 41_002, 1, "switch", "spectator"),
        log_row(2, 20, 41_003, 3, "join", "white", online=False),
        log_row(2, 21, 41_004, 3, "join", "white", busy=True),
        log_row(2, 22, 41_005, 3, "join", "king"),
        log_row(2, 23, 41_006, 3, "dance"),
    ]
    out = {r.event_id: r for r in played(spark, ready + more)}
    assert None not in out
    assert [out[k].code for k in range(5, 24)] == [1, 1, -14, 1, 1, 0, 0, 0, 1, 0, 1, 1, -4, -19, 1, -8, -9, -6, 0]
    assert (out[16].result, out[16].reason, out[16].status) == ("DRAW", "DRAW_AGREEMENT", "WAITING")


def random_log(seed: int) -> list[tuple]:
    """A row a second for each of five rooms, from 1970-01-02 on: a stream drops rows behind its first watermark, the epoch."""
    r, rows = random.Random(seed), []
    for n in range(1500):
        action = r.choice(ACTIONS)
        rows.append(log_row(n % 5, n, 86_400_000 + (n // 5) * 1000 + n % 5, r.randrange(3), action, r.choice(["white", "black", "spectator"]), time_minutes=1, increment_seconds=1))
    return rows


def test_stream_is_fold(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # the state server of Python processors speaks it
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = spark.createDataFrame(random_log(7), LOG)
    for k in range(3):  # three micro-batches
        log.where(f"at_ms - 86400000 >= {k * 100_000} and at_ms - 86400000 < {(k + 1) * 100_000}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = room_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "1 hour")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = {Row(**r.asDict()) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
    want = set(fold(log).collect())
    assert len(want) >= 1500 and {r.code for r in want} >= {1, 0, -1, -2, -3, -4, -10, -12, -13, -15, -16, -18, -19}
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
