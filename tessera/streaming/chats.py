"""Chats whose state lives in a stream: a session's messages, put, replaced and removed by id, and a room's last messages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY = 10
REDUCED = "session_id long, seq long, message_id long, effect string, size int"
PUSHED = "room_id long, event_id long, outcome string, held int"
_REDUCED, _PUSHED = (Row(*(c.split()[0] for c in ddl.split(", "))) for ddl in (REDUCED, PUSHED))


class SessionReducer(StatefulProcessor):
    """Of log(session_id, seq, op, message_id, content): a `put` appends a message or replaces the one with its id where it stands; a
    `remove` takes one out, or has no effect."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "message_id long", "stands long, content string")
        self.size = handle.getValueState("size", "size int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._put(initialState.message_id, initialState.stands, initialState.content)

    def _put(self, message: int, stands: int, content: str | None) -> str:
        known = self.messages.containsKey((message,))
        self.messages.updateValue((message,), (self.messages.getValue((message,))[0] if known else stands, content))
        if not known:
            self.size.update((self._size() + 1,))
        return "replaced" if known else "appended"

    def _size(self) -> int:
        return self.size.get()[0] if self.size.exists() else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for e in sorted(rows, key=lambda e: e.seq):
            if e.op == "put":
                effect = self._put(e.message_id, e.seq, e.content)
            elif e.op == "remove" and self.messages.containsKey((e.message_id,)):
                self.messages.removeKey((e.message_id,))
                self.size.update((self._size() - 1,))
                effect = "removed"
            else:
                effect = "none"
            yield _REDUCED(key[0], e.seq, e.message_id, effect, self._size())

    def close(self) -> None:
        pass


def reduced_stream(log: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The effect of each row of a streamed log, and how many messages its session has then. initial: session_id, message_id, stands,
    content of what a new stream starts with."""
    known = log.where("session_id is not null and seq is not null and message_id is not null").groupBy("session_id")
    return known.transformWithState(SessionReducer(), REDUCED, "Append", "None", initialState=None if initial is None else initial.groupBy("session_id"))


class RoomChat(StatefulProcessor):
    """Of log(room_id, event_id, kind, locked, sender_id, message): `settings` opens a room or changes its lock, `close` ends it; a `chat` is
    judged by the lock as it stands then and held among the last HISTORY ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.locked = handle.getValueState("locked", "locked boolean")
        self.history = handle.getListState("history", "event_id long, sender_id long, message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for e in sorted(rows, key=lambda e: e.event_id):
            if e.kind == "settings":
                self.locked.update((bool(e.locked),))
            elif e.kind == "close":
                self.locked.clear()
                self.history.clear()
            elif e.kind == "chat":
                held = list(self.history.get()) if self.history.exists() else []
                outcome = "NOT_FOUND" if not self.locked.exists() else "FORBIDDEN" if self.locked.get()[0] else "ACCEPTED"
                if outcome == "ACCEPTED":
                    held = [*map(tuple, held), (e.event_id, e.sender_id, e.message)][-HISTORY:]
                    self.history.put(held)
                yield _PUSHED(key[0], e.event_id, outcome, len(held))

    def close(self) -> None:
        pass


def room_chat_stream(log: DataFrame) -> DataFrame:
    """The outcome of each chat message of a streamed log, and how many messages its room holds then."""
    return log.where("room_id is not null and event_id is not null").groupBy("room_id").transformWithState(RoomChat(), PUSHED, "Append", "None")
