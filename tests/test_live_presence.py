from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.streaming import live, rooms

pytest.importorskip("google.protobuf")  # the state server of Python processors speaks it
START = 86_400_000  # a stream drops rows behind its first watermark, the epoch


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def beat(event, at, user, session, action, status=None, room=None, role=None, grace=None):
    return (user, event, START + at, session, action, status, room, role, grace)


def files(spark, rows, schema, folder, bounds):
    """A file, and so a micro-batch, for the rows up to each bound."""
    df = spark.createDataFrame(rows, schema)
    last = 0
    for k, z in enumerate([*bounds, 1 << 60]):
        df.where(f"at_ms >= {START + last} and at_ms < {START + z}").coalesce(1).write.parquet(f"{folder}/{k}")
        last = z
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return df, stream.parquet(folder)


def run(spark, stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_scripted_user(spark, tmp_path):
    rows = [
        beat(1, 0, 1, "a", "heartbeat"),  # no session yet
        beat(2, 1000, 1, "a", "connect"),
        beat(3, 2000, 1, "b", "connect"),
        beat(4, 3000, 1, "a", "status", "IN_ROOM", 7, "white"),
        beat(5, 20_000, 1, "a", "heartbeat"),  # b runs out at 32000
        beat(6, 40_000, 1, "b", "heartbeat"),  # void
        beat(7, 41_000, 1, "b", "disconnect"),  # void
        beat(8, 45_000, 1, "a", "disconnect"),  # offline, IN_ROOM goes
        beat(9, 46_000, 1, "a", "status", "PLAYING", 7, "white", 9000),  # offline: void
        beat(10, 47_000, 1, "a", "connect"),
        beat(11, 48_000, 1, "a", "status", "PLAYING", 7, "white", 9000),
        beat(12, 49_000, 1, "a", "disconnect"),
        beat(13, 57_000, 1, "c", "connect"),  # within the grace: still PLAYING
        beat(14, 58_000, 1, "c", "disconnect"),
        beat(15, 67_000, 1, "c", "connect"),  # at the grace's end: fresh
        beat(16, 400_000, 2, "z", "connect"),  # moves the watermark; user 1's session is closed by a timer
    ]
    _, stream = files(spark, rows, live.LOG, f"{tmp_path}/in", [30_000, 100_000])
    out = run(spark, live.presence_stream(stream), tmp_path).where("user_id = 1").orderBy("at_ms", F.col("event_id").asc_nulls_first()).collect()
    got = [(r.event_id, r.at_ms - START, r.code, r.change, r.status, r.room_id) for r in out]
    assert got == [
        (1, 0, 0, None, None, None), (2, 1000, 1, "ONLINE", "ONLINE", None), (3, 2000, 0, None, "ONLINE", None), (4, 3000, 1, None, "IN_ROOM", 7), (5, 20_000, 1, None, "IN_ROOM", 7),
        (None, 32_000, 1, None, "IN_ROOM", 7), (6, 40_000, 0, None, "IN_ROOM", 7), (7, 41_000, 0, None, "IN_ROOM", 7), (8, 45_000, 1, "OFFLINE", "IN_ROOM", 7), (9, 46_000, 0, None, None, None),
        (10, 47_000, 1, "ONLINE", "ONLINE", None), (11, 48_000, 1, None, "PLAYING", 7), (12, 49_000, 1, "OFFLINE", "PLAYING", 7), (13, 57_000, 1, "ONLINE", "PLAYING", 7), (14, 58_000, 1, "OFFLINE", "PLAYING", 7),
        (15, 67_000, 1, "ONLINE", "ONLINE", None), (None, 97_000, 1, "OFFLINE", "ONLINE", None),
    ]


def test_stream_is_fold(spark, tmp_path):
    r, rows = random.Random(5), []
    for n in range(1500):
        action = r.choice(["connect", "connect", "heartbeat", "heartbeat", "heartbeat", "disconnect", "status"])
        status, room, role, grace = (r.choice(["IN_ROOM", "PLAYING", "PLAYING", "ONLINE"]), r.choice([None, 3]), r.choice(["white", None]), r.choice([5000, 60_000])) if action == "status" else (None,) * 4
        rows.append(beat(n, n * 1500 + r.randrange(3) * 500, r.randrange(6), r.choice("abc"), action, status, room, role, grace))
    rows.append(beat(9999, 10_000_000, 99, "z", "connect"))
    log, stream = files(spark, rows, live.LOG, f"{tmp_path}/in", [700_000, 1_500_000, 5_000_000])
    out = run(spark, live.presence_stream(stream, "1 minute"), tmp_path).where("user_id < 99")
    ends = {(x.user_id, x.at_ms, x.action, x.status, x.room_id, x.role) for x in out.where("change = 'OFFLINE'").collect()}
    starts = {(x.user_id, x.at_ms) for x in out.where("change = 'ONLINE'").collect()}
    fold = live.periods(log).where("user_id < 99").collect()
    assert len(fold) > 80 and {x.cause for x in fold} == {"expire", "disconnect"} and {x.status for x in fold} == {"ONLINE", "IN_ROOM", "PLAYING"}
    assert ends == {(x.user_id, x.ended_ms, x.cause, x.status, x.room_id, x.role) for x in fold}
    assert starts == {(x.user_id, x.started_ms) for x in fold}


def test_a_lapsed_session_leaves_the_room(spark, tmp_path):
    act = lambda room, event, at, user, action, role=None: (room, event, START + at, user, action, role, True, False, 10, 0, False, False)
    room_rows = [act(7, 1, 1000, 1, "create", "white"), act(7, 2, 2000, 2, "join", "black"), act(8, 3, 3000, 5, "create", "white"), act(9, 4, 600_000, 9, "create", "white")]
    presence = [
        beat(1, 500, 1, "a", "connect"), beat(2, 1100, 1, "a", "status", "IN_ROOM", 7, "white"), beat(3, 1500, 2, "a", "connect"), beat(4, 2100, 2, "a", "status", "IN_ROOM", 7, "black"), beat(5, 20_000, 2, "a", "heartbeat"),
        beat(6, 2200, 4, "a", "connect"), beat(7, 2300, 4, "a", "status", "IN_ROOM", 8, "white"),  # not in room 8 at all: its leave is refused and passed over
        beat(8, 2200, 5, "a", "connect"), beat(9, 3100, 5, "a", "status", "PLAYING", 8, "white", 1000),  # playing: stays in the room
        beat(10, 600_000, 9, "z", "connect"),
    ]
    _, room_stream = files(spark, room_rows, rooms.LOG, f"{tmp_path}/rooms", [10_000])
    _, presence_stream = files(spark, presence, live.LOG, f"{tmp_path}/presence", [10_000])
    out = run(spark, live.rooms_with_presence(room_stream, presence_stream), tmp_path).where("room_id < 9").orderBy("at_ms").collect()
    assert [(r.room_id, r.at_ms - START, r.user_id, r.action, r.code, r.note, r.reason, r.host_id) for r in out] == [
        (7, 1000, 1, "create", 1, "ROOM_CREATED", None, 1), (7, 2000, 2, "join", 1, "JOINED", None, 1), (8, 3000, 5, "create", 1, "ROOM_CREATED", None, 5),
        (7, 30_500, 1, "leave", 1, "HOST_TRANSFERRED", "DISCONNECT", 2), (7, 50_000, 2, "leave", 1, "ROOM_EMPTY", "DISCONNECT", None),
    ]


class Counted:
    """A state store of one user in memory that counts calls: a value, a map and timers."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            elif name in ("updateValue", "removeKey"):
                self.map.pop(args[0], None) if name == "removeKey" else self.map.update([args])
            elif name in ("registerTimer", "deleteTimer"):
                self.timers ^= {args[0]}
            return {"get": self.value, "exists": self.value is not None, "keys": iter(list(self.map)), "iterator": iter(list(self.map.items())), "containsKey": name == "containsKey" and args[0] in self.map, "listTimers": iter(self.timers)}.get(name)

        return call


def test_state_is_read_and_written_once_for_all_rows_of_a_user():
    log = [beat(0, 0, 1, "a", "connect"), *(beat(n, n * 1000, 1, "a", "heartbeat") if n % 3 else beat(n, n * 1000, 1, "a", "status", "IN_ROOM", n, "white") for n in range(1, 400))]
    rows = [Row(**e, row=json.dumps(e)) for e in (dict(zip(live.COLUMNS, e)) for e in log)]
    state, p = Counted(), live.PresenceProcessor()
    p.init(state)
    out = list(p.handleInputRows((1,), iter(rows[::-1]), None))
    assert [(r.event_id, r.code) for r in out] == [(n, 1) for n in range(400)] and out[-1].room_id == 399
    assert state.timers == {START + 398_000 + live.TTL_MS} and state.calls < 10


def test_only_changes(spark, tmp_path):
    rows = [beat(1, 0, 1, "a", "connect"), beat(2, 5000, 1, "a", "status", "PLAYING", (1 << 60) + 1, 'wh"ite', 9000), beat(3, 6000, 1, "b", "connect"), beat(4, 7000, 1, "a", "disconnect"), beat(5, 20_000, 1, "b", "heartbeat"), beat(6, 400_000, 2, "z", "connect")]
    _, stream = files(spark, rows, live.LOG, f"{tmp_path}/in", [6500, 100_000])
    out = run(spark, live.presence_stream(stream, changes=True), tmp_path).where("user_id = 1").orderBy("at_ms").collect()
    assert [(r.at_ms - START, r.action, r.change, r.status, r.room_id, r.role) for r in out] == [(0, "connect", "ONLINE", "ONLINE", None, None), (50_000, "expire", "OFFLINE", "PLAYING", (1 << 60) + 1, 'wh"ite')]
