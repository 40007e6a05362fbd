"""Who is online, from connects, heartbeats, disconnects and status changes: a stream processor by user, its batch fold, and rooms fed by it.

log: user_id, event_id, at_ms, session_id, action (connect, heartbeat, disconnect, status), status, room_id, role, grace_ms. A session
lives for TTL_MS after its last connect or heartbeat; a heartbeat of a session that is over is void. The first session makes a user
ONLINE unless a status is still held (a reconnect keeps it); a status counts only while a session is open and replaces room and role
too. With the last session the status goes, but for PLAYING with room and role, which is held for grace_ms more. At one moment what
runs out comes before what a user does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming import rooms

TTL_MS = 30_000
LOG = "user_id long, event_id long, at_ms long, session_id string, action string, status string, room_id long, role string, grace_ms long"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
OUT = "user_id long, event_id long, at_ms long, at timestamp, session_id string, action string, code int, change string, status string, room_id long, role string"
RESULT = Row(*(c.split()[0] for c in OUT.split(", ")))
HELD = "status string, room_id long, role string, grace_ms long, until long"
KEPT = f"{HELD}, sessions map<string, long>, timer long"


class PresenceProcessor(StatefulProcessor):
    """A row for each row of the log, code 1 if it took effect, and one, action `expire`, for each session that runs out. change: ONLINE
    or OFFLINE where the first session comes or the last goes; status, room_id, role: as held then (OFFLINE: as held before). With
    `changes`, only rows that have a change.

    What is known of a user is one value of the state store, read and written once for all of the user's rows of a batch; rows come as
    (user_id, at, row), the rest of the log's columns in JSON, as each column costs more to hand over than to parse."""

    def __init__(self, changes: bool = False) -> None:
        self.changes = changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    def _load(self) -> None:
        self.before = self.kept.get()
        *held, sessions, self.timer = self.before or (*[None] * 5, {}, None)
        self.held = tuple(held) if held[0] is not None else None
        self.sessions = dict(sessions)

    def _store(self, expired: int | None = None) -> None:
        """Keeps what is known, and one timer for what runs out first; Spark itself deletes the timer that has `expired`."""
        until = self.held[4] if self.held else None
        timer = min([*self.sessions.values(), *[until] * (until is not None)], default=None)
        if timer != self.timer:
            if self.timer not in (None, expired):
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if self.held or self.sessions:
            after = (*(self.held or [None] * 5), self.sessions, timer)
            if after != self.before:
                self.kept.update(after)
        elif self.before:
            self.kept.clear()

    def _row(self, user: int, event: int | None, at: int, session: str | None, action: str, code: int, change: str | None = None) -> list[Row]:
        if self.changes and change is None:
            return []
        held = self.held or (None, None, None)
        return [RESULT(user, event, at, datetime.fromtimestamp(at / 1000, UTC), session, action, code, change, held[0], held[1], held[2])]

    def _close(self, user: int, event: int | None, at: int, session: str, action: str) -> list[Row]:
        del self.sessions[session]
        if self.sessions:
            return self._row(user, event, at, session, action, 1)
        out = self._row(user, event, at, session, action, 1, "OFFLINE")
        status, room, role, grace, _ = self.held
        if status == "PLAYING" and room is not None and role is not None and (grace or 0) > 0:
            self.held = (status, room, role, grace, at + grace)
        else:
            self.held = None
        return out

    def _due(self, user: int, now: int) -> Iterator[Row]:
        if self.sessions and min(self.sessions.values()) <= now:
            for ends, session in sorted((ends, session) for session, ends in self.sessions.items() if ends <= now):
                yield from self._close(user, None, ends, session, "expire")
        if self.held and self.held[4] is not None and self.held[4] <= now:
            self.held = None

    def _apply(self, user: int, event: int, at: int, session: str | None, action: str, status: str | None, room: int | None, role: str | None, grace: int | None) -> list[Row]:
        if action == "connect" and session is not None:
            first = not self.sessions
            self.sessions[session] = at + TTL_MS
            if first:
                self.held = (*(self.held or ("ONLINE", None, None, None))[:4], None)
            return self._row(user, event, at, session, action, int(first), "ONLINE" if first else None)
        if action == "heartbeat" and session in self.sessions:
            self.sessions[session] = at + TTL_MS
        elif action == "disconnect" and session in self.sessions:
            return self._close(user, event, at, session, action)
        elif action == "status" and status is not None and self.sessions:
            self.held = (status, room, role, grace, None)
        else:
            return self._row(user, event, at, session, action, 0)
        return self._row(user, event, at, session, action, 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        for e in sorted((tuple(map(json.loads(e.row).get, COLUMNS[1:])) for e in rows), key=itemgetter(1, 0)):
            yield from self._due(key[0], e[1])
            yield from self._apply(key[0], *e)
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed: a timer set here would wait for the next batch
        self._load()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._due(key[0], max(expired, timerValues.getCurrentWatermarkInMs()))
        self._store(expired)

    def close(self) -> None:
        pass


def presence_stream(log: DataFrame, late: str = "10 seconds", changes: bool = False) -> DataFrame:
    """Presence of a streamed log, or only its changes; rows `late` or more behind are dropped, rows without a user or time are left out.
    Needs the RocksDB state store."""
    known = log.select(COLUMNS).where("user_id is not null and at_ms is not null and event_id is not null")
    timed = known.select("user_id", F.timestamp_millis("at_ms").alias("at"), F.to_json(F.struct(COLUMNS[1:])).alias("row")).withWatermark("at", late)
    return timed.groupBy("user_id").transformWithState(PresenceProcessor(changes), OUT, "Append", "EventTime", eventTimeColumnName="at")


def disconnects(presence: DataFrame) -> DataFrame:
    """Rows of the room log that users who went offline in a room leave behind; their event_id is negative."""
    gone = presence.where("change = 'OFFLINE' and status = 'IN_ROOM' and room_id is not null")
    made = {"event_id": -1 - F.col("user_id"), "action": F.lit("leave"), "online": F.lit(False), "busy": F.lit(True)}
    types = {c.split()[0]: c.split()[1] for c in rooms.LOG.split(", ")}
    return gone.select(*[made[c].cast(types[c]).alias(c) if c in made else F.col(c).cast(types[c]).alias(c) if c in ("room_id", "at_ms", "user_id") else F.lit(None).cast(types[c]).alias(c) for c in rooms.COLUMNS], "at")


def rooms_with_presence(room_log: DataFrame, presence_log: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Room results where users who go offline in a room leave it: two stateful operators in one query, the rooms reading what presence
    gives out. Refused leaves of that kind are passed over; others have the reason DISCONNECT."""
    timed = room_log.select(rooms.COLUMNS).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    both = timed.unionByName(disconnects(presence_stream(presence_log, late, changes=True)))
    out = both.groupBy("room_id").transformWithState(rooms.RoomProcessor(), rooms.OUT, "Append", "EventTime")
    lapsed = F.expr("action = 'leave' and event_id < 0")
    return out.where(~lapsed | (F.col("code") > 0)).withColumn("reason", F.when(lapsed, F.lit("DISCONNECT")).otherwise(F.col("reason")))


#: The fold of a whole log, the table {log}: a row for each time that a user was online, with what was held at its end. Rows of a session
#: that follow each other within the TTL belong together, from the first connect on; starts and ends of all sessions of a user, counted in
#: order, give the times online; a status is carried over times without one of their own while each gap is shorter than its grace.
PERIODS = f"""with b as (select user_id, session_id, at_ms, event_id, action, lag(at_ms) over (partition by user_id, session_id order by at_ms, event_id) as prev_at,
    lag(action) over (partition by user_id, session_id order by at_ms, event_id) as prev_action from {{log}} where action in ('connect', 'heartbeat', 'disconnect') and session_id is not null),
i as (select *, sum(case when prev_at is null or at_ms - prev_at >= {TTL_MS} or prev_action = 'disconnect' then 1 else 0 end) over (partition by user_id, session_id order by at_ms, event_id rows between unbounded preceding and current row) as stay from b),
n as (select *, row_number() over (partition by user_id, session_id, stay, action order by at_ms, event_id) as nth from i),
s as (select user_id, session_id, stay, max(case when action = 'connect' and nth = 1 then at_ms end) as start_at, max(case when action = 'connect' and nth = 1 then event_id end) as start_id,
    max(case when action = 'disconnect' then event_id end) as end_id, max(at_ms) as last_at from n group by user_id, session_id, stay),
e as (select user_id, start_at as at_ms, 1 as kind, start_id as event_id, session_id, 1 as step from s where start_at is not null
  union all select user_id, case when end_id is null then last_at + {TTL_MS} else last_at end, case when end_id is null then 0 else 1 end, coalesce(end_id, 0), session_id, -1 from s where start_at is not null
  union all select user_id, at_ms, 1, event_id, '', 0 from {{log}} where action = 'status' and status is not null),
w as (select *, sum(step) over (partition by user_id order by at_ms, kind, event_id, session_id rows between unbounded preceding and current row) as opened from e),
k as (select *, sum(case when step = 1 and opened = 1 then 1 else 0 end) over (partition by user_id order by at_ms, kind, event_id, session_id rows between unbounded preceding and current row) as number from w),
p as (select user_id, number, min(at_ms) as started_ms, max(case when step = -1 and opened = 0 then at_ms end) as ended_ms, max(case when step = -1 and opened = 0 then kind end) as said from k where step <> 0 and number > 0 group by user_id, number),
h as (select user_id, number, event_id, row_number() over (partition by user_id, number order by at_ms desc, event_id desc) as nth from k where step = 0 and opened > 0),
l as (select h.user_id, h.number, x.status, x.room_id, x.role, x.grace_ms from h join {{log}} x on x.user_id = h.user_id and x.event_id = h.event_id and x.action = 'status' where h.nth = 1),
q as (select p.*, l.status, l.room_id, l.role, coalesce(l.grace_ms, 0) as grace_ms, p.started_ms - lag(p.ended_ms) over (partition by p.user_id order by p.number) as gap,
    sum(case when l.status is not null then 1 else 0 end) over (partition by p.user_id order by p.number rows between unbounded preceding and current row) as part from p left join l on l.user_id = p.user_id and l.number = p.number),
f as (select *, first_value(status) over (partition by user_id, part order by number) as status0, first_value(room_id) over (partition by user_id, part order by number) as room0,
    first_value(role) over (partition by user_id, part order by number) as role0, first_value(grace_ms) over (partition by user_id, part order by number) as grace0 from q),
g as (select *, max(case when status is null and (status0 is null or status0 <> 'PLAYING' or room0 is null or role0 is null or gap >= grace0) then 1 else 0 end) over (partition by user_id, part order by number rows between unbounded preceding and current row) as lost from f)
select user_id, started_ms, ended_ms, case when said = 0 then 'expire' else 'disconnect' end as cause, case when lost = 1 or status0 is null then 'ONLINE' else status0 end as status,
  case when lost = 1 then null else room0 end as room_id, case when lost = 1 then null else role0 end as role from g"""


def periods(log: DataFrame) -> DataFrame:
    """user_id, started_ms, ended_ms, cause, status, room_id, role of each time that a user was online."""
    return log.sparkSession.sql(PERIODS, log=log)
