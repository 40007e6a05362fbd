from __future__ import annotations

import random

import pytest

from tessera.operators.commands import reduced_chat
from tessera.streaming import chats, rooms, snapshots
from test_rooms import random_log

pytest.importorskip("google.protobuf")


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run(spark, stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_messages_are_replaced_and_removed_after_a_restart(spark, tmp_path):
    r, schema = random.Random(2), "session_id long, seq long, op string, message_id long, content string"
    rows = [(r.randrange(4), n + 10, r.choice(["put", "put", "remove"]), r.randrange(6), f"c{n}") for n in range(300)]
    initial = spark.createDataFrame([(0, 77, 1, "before"), (0, 1, 2, "first"), (9, 5, 2, "alone")], "session_id long, message_id long, stands long, content string")
    for k in range(3):  # the stream is started anew for each part
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        out = run(spark, chats.reduced_stream(source(spark, tmp_path, schema), initial), tmp_path)
    old = [(r.session_id, r.stands, "put", r.message_id, r.content) for r in initial.collect()]
    want = sorted(map(tuple, reduced_chat(spark.createDataFrame(old + rows, schema)).collect()))
    found = {r.seq: (r.effect, r.size) for r in out.collect()}
    held = {s: {m for t, m in ((0, 77), (0, 1), (9, 5)) if t == s} for s in range(10)}
    for s, seq, op, m, _ in rows:
        effect = ("replaced" if m in held[s] else "appended") if op == "put" else "removed" if m in held[s] else "none"
        (held[s].add if op == "put" else held[s].discard)(m)
        assert found[seq] == (effect, len(held[s])), (s, seq)
    live = sorted(map(tuple, snapshots.live_messages(spark, f"{tmp_path}/ck").collect()))
    assert set(live) - set(want) == set() == set(want) - set(live)


def test_the_lock_is_read_when_a_message_comes(spark, tmp_path):
    schema = "room_id long, event_id long, kind string, locked boolean, sender_id long, message string"
    rows = [(1, 1, "chat", None, 5, "early"), (1, 2, "settings", False, None, None), *[(1, n, "chat", None, 5, f"m{n}") for n in range(3, 16)], (1, 16, "settings", True, None, None), (1, 17, "chat", None, 5, "no")]
    later = [(1, 18, "settings", False, None, None), (1, 19, "chat", None, 6, "again"), (2, 20, "settings", None, None, None), (2, 21, "chat", None, 6, "x"), (2, 22, "close", None, None, None), (2, 23, "chat", None, 6, "y")]
    for k, part in enumerate((rows, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        out = run(spark, chats.room_chat_stream(source(spark, tmp_path, schema)), tmp_path)
    got = {r.event_id: (r.outcome, r.held) for r in out.collect()}
    assert got == {1: ("NOT_FOUND", 0), **{n: ("ACCEPTED", min(10, n - 2)) for n in range(3, 16)}, 17: ("FORBIDDEN", 10), 19: ("ACCEPTED", 10), 21: ("ACCEPTED", 1), 23: ("NOT_FOUND", 0)}
    held = snapshots.state_of(spark, f"{tmp_path}/ck", "history").orderBy("event_id").collect()
    assert [r.event_id for r in held] == [*range(7, 16), 19]


def test_live_rooms_are_the_last_rows_of_the_fold(spark, tmp_path):
    log = spark.createDataFrame(random_log(11)[:900], rooms.LOG)
    log.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    run(spark, rooms.room_stream(source(spark, tmp_path, log.schema), "1 hour"), tmp_path)
    last = {}
    for r in sorted(rooms.fold(log).collect(), key=lambda r: (r.at_ms, r.event_id if r.event_id is not None else -1)):
        last[r.room_id] = r
    want = {k: (r.status, r.host_id, r.white_id, r.black_id, r.turn, r.ply) for k, r in last.items() if r.status is not None and r.host_id is not None}
    asked = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 99)], "room_id long")
    live = {r.room_id: r for r in snapshots.live_rooms(spark, f"{tmp_path}/ck", asked).collect()}
    assert len(live) == 6 and live[99].status is None
    assert want and {k: (r.status, r.host, r.white, r.black, r.turn, r.ply) for k, r in live.items() if r.status is not None} == want
    seen = snapshots.live_spectators(spark, f"{tmp_path}/ck").collect()
    for k in {r.room_id for r in seen}:
        mine = sorted((r.place, r.since, r.size) for r in seen if r.room_id == k)
        assert [m[0] for m in mine] == list(range(mine[0][2])) and mine == sorted(mine, key=lambda m: m[1])


def test_timers_of_a_silent_room_follow_each_other(spark, tmp_path):
    act = lambda room, event, at, user, action, role=None: (room, event, 86_400_000 + at, user, action, role, True, False, 1, 0, False, False)
    rows = [act(1, 1, 0, 1, "create", "white"), act(1, 2, 1, 2, "join", "black"), act(1, 3, 2, 1, "ready"), act(1, 4, 3, 2, "ready"), act(2, 5, 900_000, 9, "create", "white")]
    spark.createDataFrame(rows, rooms.LOG).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    out = run(spark, rooms.room_stream(source(spark, tmp_path, spark.createDataFrame(rows, rooms.LOG).schema)), tmp_path)
    ends = out.where("event_id is null").orderBy("at_ms").collect()
    assert [(r.action, r.at_ms - 86_400_000, r.result, r.reason) for r in ends] == [("start", 3003, None, None), ("timeout", 63_003, "BLACK_WIN", "TIMEOUT")]
