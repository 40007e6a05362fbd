"""Rooms and their games as one state machine by room: a stream processor, and a batch fold over the same log.

log: room_id, event_id, at_ms, user_id, action, role, online, busy, time_minutes, increment_seconds, is_private,
spectators_locked. `online` and `busy` (already in a room) come from the presence log, which has another key.
Every row of the log gives a row with its result code; a countdown or a clock that runs out gives a row of its own,
without event_id, before the first later row of the room, or in the stream when the watermark passes.

A room is handled in order by one task, as a game needs; rows stream through it, so that memory holds one room's seats and
spectators and never its log. Moves are trusted: there are no board rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTDOWN_MS, DRAW_OFFER_MS = 3000, 30_000
LOG = "room_id long, event_id long, at_ms long, user_id long, action string, role string, online boolean, busy boolean, time_minutes int, increment_seconds int, is_private boolean, spectators_locked boolean"
OUT = "room_id long, event_id long, at_ms long, user_id long, action string, code int, note string, status string, host_id long, white_id long, black_id long, turn string, white_ms long, black_ms long, ply long, result string, reason string, grace_ms long"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
RESULT = Row(*(c.split()[0] for c in OUT.split(", ")))
OTHER = {"white": "black", "black": "white"}


@dataclass
class Room:
    status: str = "WAITING"
    host: int | None = None
    white: int | None = None
    black: int | None = None
    white_ready: bool = False
    black_ready: bool = False
    start_at: int | None = None
    base_ms: int = 600_000
    increment_ms: int = 0
    is_private: bool = False
    spectators_locked: bool = False
    turn: str | None = None
    turn_at: int | None = None
    white_ms: int | None = None
    black_ms: int | None = None
    ply: int = 0
    draw_by: int | None = None
    draw_until: int = 0
    late: int | None = None  # who lost the last game on time

    def seat(self, user: int) -> str | None:
        return next((c for c in OTHER if getattr(self, c) == user), None)

    def sit(self, color: str, user: int | None) -> None:
        setattr(self, color, user)
        setattr(self, f"{color}_ready", False)

    def clock(self, color: str) -> int:
        return getattr(self, f"{color}_ms")

    def deadline(self) -> int | None:
        """When something happens without a user."""
        if self.status == "COUNTDOWN":
            return self.start_at
        return self.turn_at + self.clock(self.turn) if self.status == "IN_PROGRESS" else None

    def start(self) -> None:
        self.status, self.turn, self.turn_at, self.ply, self.late = "IN_PROGRESS", "white", self.start_at, 0, None
        self.white_ms = self.black_ms = self.base_ms

    def end(self) -> None:
        self.status, self.white_ready, self.black_ready, self.start_at = "WAITING", False, False, None
        self.turn = self.turn_at = self.white_ms = self.black_ms = self.draw_by = None


STATE = ", ".join(f"{f.name} {'string' if 'str' in f.type else 'boolean' if 'bool' in f.type else 'long'}" for f in fields(Room))


class Refused(Exception):
    """args[0]: result code."""


def _need(holds: bool, code: int) -> None:
    if not holds:
        raise Refused(code)


def _lost(loser: str, reason: str) -> dict:
    return {"result": f"{OTHER[loser].upper()}_WIN", "reason": reason}


def _create(_: None, e: Row, spectators: MutableMapping) -> tuple[dict, Room]:
    _need(bool(e.online), -8)
    _need(not e.busy, -9)
    _need(e.role in OTHER, -6)
    room = Room(host=e.user_id, is_private=bool(e.is_private), spectators_locked=bool(e.spectators_locked))
    room.base_ms = (10 if e.time_minutes is None else e.time_minutes) * 60_000
    room.increment_ms = (e.increment_seconds or 0) * 1000
    room.sit(e.role, e.user_id)
    return {"note": "ROOM_CREATED"}, room


def _join(room: Room, e: Row, spectators: MutableMapping) -> dict:
    _need(room.status == "WAITING" or e.role == "spectator", -2)
    _need(not room.is_private, -7)
    _need(room.seat(e.user_id) is None, -3)
    if e.role in OTHER:
        _need(getattr(room, e.role) is None, -4)
        room.sit(e.role, e.user_id)
    else:
        _need(e.role == "spectator", -6)
        _need(not room.spectators_locked, -5)
        spectators[e.user_id] = e.at_ms
    return {"note": "JOINED"}


def _leave(room: Room, e: Row, spectators: MutableMapping) -> dict:
    """The host's place goes to white, else black, else the spectator who came first; else the room ends."""
    watched = e.user_id in spectators
    color = room.seat(e.user_id)
    if watched:
        del spectators[e.user_id]
        if room.host != e.user_id:
            return {"note": "SPECTATOR_LEFT"}
    else:
        _need(room.status != "IN_PROGRESS", -18)
        _need(color is not None or room.host == e.user_id, -10)
    if color:
        room.sit(color, None)
    if room.status == "COUNTDOWN":
        room.status, room.start_at = "WAITING", None
    if room.host != e.user_id:
        return {"note": "PLAYER_LEFT"}
    room.host = room.white if room.white is not None else room.black
    if room.host is None:
        room.host = min(((at, user) for user, at in spectators.items()), default=(0, None))[1]
    return {"note": "ROOM_EMPTY" if room.host is None else "HOST_TRANSFERRED"}


def _switch(room: Room, e: Row, spectators: MutableMapping) -> dict:
    _need(room.status == "WAITING", -2)
    now = room.seat(e.user_id) or ("spectator" if e.user_id in spectators else None)
    _need(now is not None, -10)
    _need(now != e.role, -19)
    _need(e.role in OTHER or e.role == "spectator", -6)
    _need(e.role not in OTHER or getattr(room, e.role) is None, -4)
    if now in OTHER:
        room.sit(now, None)
    else:
        del spectators[e.user_id]
    if e.role in OTHER:
        room.sit(e.role, e.user_id)
    else:
        spectators[e.user_id] = e.at_ms
    return {"note": now}


def _ready(room: Room, e: Row, spectators: MutableMapping) -> dict:
    _need(room.status in ("WAITING", "COUNTDOWN"), -2)
    color = room.seat(e.user_id)
    _need(color is not None, -12)
    setattr(room, f"{color}_ready", e.action == "ready")
    if e.action == "unready" and room.status == "COUNTDOWN":
        room.status, room.start_at = "WAITING", None
        return {"note": "COUNTDOWN_CANCELLED"}
    if room.status == "WAITING" and room.white_ready and room.black_ready:
        room.status, room.start_at = "COUNTDOWN", e.at_ms + COUNTDOWN_MS
        return {"note": "COUNTDOWN_STARTED"}
    return {}


def _start(room: Room, e: Row, spectators: MutableMapping) -> dict:
    _need(room.status == "COUNTDOWN", -13)
    _need(e.at_ms >= room.start_at, -14)
    room.start()
    return {"note": "GAME_STARTED"}


def _move(room: Room, e: Row, spectators: MutableMapping) -> dict:
    """The clock has time left: a clock that ran out has ended the game already."""
    if room.status != "IN_PROGRESS":
        raise Refused(-17 if room.late == e.user_id else -16)
    color = room.seat(e.user_id)
    _need(color is not None, -12)
    _need(color == room.turn, -15)
    setattr(room, f"{color}_ms", room.clock(color) - max(0, e.at_ms - room.turn_at) + room.increment_ms)
    room.turn, room.turn_at, room.ply = OTHER[color], e.at_ms, room.ply + 1
    return {"note": color}


def _over(room: Room, e: Row, spectators: MutableMapping) -> dict:
    """Resignation and draws. A draw offer is used up by the answer, even by the answer of who made it."""
    color = room.seat(e.user_id)
    _need(color is not None, -12)
    _need(room.status == "IN_PROGRESS", 0)
    if e.action == "resign":
        room.end()
        return _lost(color, "RESIGN")
    if room.draw_by is not None and room.draw_until <= e.at_ms:
        room.draw_by = None
    if e.action == "offer_draw":
        _need(room.draw_by is None, 0)
        room.draw_by, room.draw_until = e.user_id, e.at_ms + DRAW_OFFER_MS
        return {"note": "DRAW_OFFERED"}
    by, room.draw_by = room.draw_by, None
    _need(by is not None and by != e.user_id, 0)
    if e.action == "decline_draw":
        return {"note": "DRAW_DECLINED"}
    room.end()
    return {"result": "DRAW", "reason": "DRAW_AGREEMENT"}


def _drop(room: Room, e: Row, spectators: MutableMapping) -> dict:
    """A player who goes offline in a game is kept for what is left of the clock."""
    color = room.seat(e.user_id)
    _need(color is not None, -12)
    _need(room.status == "IN_PROGRESS", 0)
    used = max(0, e.at_ms - room.turn_at) if room.turn == color else 0
    return {"note": color, "grace_ms": max(0, room.clock(color) - used)}


def _delete(room: Room, e: Row, spectators: MutableMapping) -> dict:
    return {"note": "ROOM_DELETED"}


STEPS: dict[str, Callable] = {
    "join": _join, "leave": _leave, "switch": _switch, "ready": _ready, "unready": _ready, "start": _start, "move": _move,
    "resign": _over, "offer_draw": _over, "accept_draw": _over, "decline_draw": _over, "drop": _drop, "delete": _delete,
}


def _row(room: Room | None, room_id: int, event_id: int | None, at: int, user: int | None, action: str, code: int, said: dict) -> tuple:
    r = room or Room(status=None)
    return (room_id, event_id, at, user, action, code, said.get("note"), r.status, r.host, r.white, r.black, r.turn, r.white_ms, r.black_ms, r.ply, said.get("result"), said.get("reason"), said.get("grace_ms"))


def due(room: Room | None, room_id: int, now: int) -> Iterator[tuple]:
    """What has happened by itself up to `now`."""
    while room and (at := room.deadline()) is not None and at <= now:
        if room.status == "COUNTDOWN":
            room.start()
            yield _row(room, room_id, None, at, None, "start", 1, {"note": "GAME_STARTED"})
        else:
            said = _lost(room.turn, "TIMEOUT")
            late = getattr(room, room.turn)
            room.end()
            room.late = late
            yield _row(room, room_id, None, at, None, "timeout", 1, said)


def apply(room: Room | None, spectators: MutableMapping, e: Row) -> tuple[Room | None, list[tuple]]:
    """The room after a row of the log (None: there is none), and the rows that come out."""
    wants_start = e.action == "start" and room and room.status == "COUNTDOWN"
    out = [] if wants_start else list(due(room, e.room_id, e.at_ms))
    said, code = {}, 1
    try:
        if e.action == "create":
            _need(room is None, -9)
            said, room = _create(None, e, spectators)
        else:
            if e.action == "join":  # these come before the room is looked up
                _need(bool(e.online), -8)
                _need(not e.busy, -9)
            _need(room is not None, -1)
            _need(e.action in STEPS, 0)
            said = STEPS[e.action](room, e, spectators)
    except Refused as no:
        code = no.args[0]
    if said.get("note") in ("ROOM_EMPTY", "ROOM_DELETED"):
        room = None
        spectators.clear()
    out.append(_row(room, e.room_id, e.event_id, e.at_ms, e.user_id, e.action, code, said))
    return room, out


def fold(log: DataFrame) -> DataFrame:
    """Results of a whole log: rooms are spread by hash and sorted by time; each partition is read once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, room, spectators = None, None, {}
        for b in batches:
            out = []
            for e in map(Row(*COLUMNS), *(b[c].astype(object).where(b[c].notna(), None) for c in COLUMNS)):
                if e.room_id != at:
                    at, room, spectators = e.room_id, None, {}
                room, rows = apply(room, spectators, e)
                out += rows
            yield pd.DataFrame(out, columns=list(RESULT))

    return log.select(COLUMNS).repartition("room_id").sortWithinPartitions("room_id", "at_ms", "event_id").mapInPandas(run, OUT)


class _Spectators(MutableMapping):
    """A MapState of the stream: user -> since when."""

    def __init__(self, state) -> None:
        self.state = state

    def __contains__(self, user) -> bool:
        return self.state.containsKey((user,))

    def __getitem__(self, user) -> int:
        return self.state.getValue((user,))[0]

    def __setitem__(self, user, at) -> None:
        self.state.updateValue((user,), (at,))

    def __delitem__(self, user) -> None:
        self.state.removeKey((user,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def items(self):
        return ((k[0], v[0]) for k, v in self.state.iterator())

    def clear(self) -> None:
        self.state.clear()


class RoomProcessor(StatefulProcessor):
    """Rows of one micro-batch are taken in order of time. Timers end countdowns and clocks of silent rooms."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.room = handle.getValueState("room", STATE)
        self.spectators = _Spectators(handle.getMapState("spectators", "user_id long", "since long"))

    def _read(self) -> Room | None:
        return Room(*self.room.get()) if self.room.exists() else None

    def _write(self, room: Room | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if room is None:
            self.room.clear()
            return
        self.room.update(astuple(room))
        if room.deadline() is not None:
            self.handle.registerTimer(room.deadline())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        room = self._read()
        for e in sorted(rows, key=lambda e: (e.at_ms, e.event_id)):
            room, out = apply(room, self.spectators, e)
            yield from (RESULT(*r) for r in out)
        self._write(room)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        room = self._read()
        # all that the watermark has passed: the clock that a start sets would wait for the next batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        yield from (RESULT(*r) for r in list(due(room, key[0], now)))
        self._write(room)

    def close(self) -> None:
        pass


def room_stream(log: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Live results of a streamed log; rows `late` or more behind are dropped. Needs the RocksDB state store."""
    timed = log.select(COLUMNS).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("room_id").transformWithState(RoomProcessor(), OUT, "Append", "EventTime")
