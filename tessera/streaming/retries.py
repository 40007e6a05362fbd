"""A queue's consumer that tries each message on its own: what fails comes again after a growing pause, and is dead after some attempts.

Other messages of a batch go through meanwhile, nothing waits on the driver, and attempts are kept in the state store, so that they
outlive a restart. A message that is delivered again while it waits for its next attempt is not handled twice for that. Messages are dealt
to SLOTS groups by their id: the state store is asked once for a group and batch, not for each message.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "message_id long, body string, outcome string, attempts int, error string"
RESULT = Row(*(c.split()[0] for c in OUT.split(", ")))
WAITING = "message_id long, body string, attempts int, due long"
SLOTS = 1024


class RetryProcessor(StatefulProcessor):
    """handle(body, attempt) raises what it can't do; attempts count from 1."""

    def __init__(self, handle: Callable[[str, int], None], attempts: int, pause: float, factor: float, most: float) -> None:
        self.handle_message, self.attempts, self.pause, self.factor, self.most = handle, attempts, pause, factor, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)

    def _try(self, message: int, body: str, attempt: int, now: int, again: list[tuple]) -> Iterator[Row]:
        """The end of a message, or nothing if it goes to `again`."""
        try:
            self.handle_message(body, attempt)
        except Exception as e:  # noqa: BLE001  any failure of the consumer counts
            if attempt < self.attempts:
                again.append((message, body, attempt, now + max(1, int(1000 * min(self.most, self.pause * self.factor ** (attempt - 1))))))
                return
            outcome, error = "dead", str(e)[:500]
        else:
            outcome, error = "stored", None
        yield RESULT(message, body, outcome, attempt, error)

    def _wake(self, again: list[tuple]) -> None:
        for due in {x[3] for x in again}:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, again = {x[0] for x in self.waiting.get()}, []
        for e in rows:
            if e.message_id not in known:
                yield from self._try(e.message_id, e.body, 1, timerValues.getCurrentProcessingTimeInMs(), again)
                if again and again[-1][0] == e.message_id:
                    known.add(e.message_id)
        if again:
            self.waiting.appendList(again)
            self._wake(again)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held, again = timerValues.getCurrentProcessingTimeInMs(), list(self.waiting.get()), []
        due = [x for x in held if x[3] <= now]
        for message, body, attempts, _ in due:
            yield from self._try(message, body, attempts + 1, now, again)
        if due:
            left = [x for x in held if x[3] > now] + again
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            self._wake(again)

    def close(self) -> None:
        pass


def retried(messages: DataFrame, handle: Callable[[str, int], None], attempts: int = 3, pause: float = 1.0, factor: float = 2.0, most: float = 10.0) -> DataFrame:
    """The end of each of messages(message_id, body): stored or dead, with the number of attempts and the last error. Needs the RocksDB state store."""
    known = messages.select(F.col("message_id").cast("long").alias("message_id"), F.col("body").cast("string").alias("body")).where("message_id is not null")
    dealt = known.withColumn("slot", F.pmod(F.xxhash64("message_id"), F.lit(SLOTS)))
    return dealt.groupBy("slot").transformWithState(RetryProcessor(handle, attempts, pause, factor, most), OUT, "Append", "ProcessingTime")


def settled(ends: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of ends into `folder`, partitioned by outcome: the table, and the dead letters beside it."""
    return ends.writeStream.format("parquet").partitionBy("outcome").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()


def drain(q: StreamingQuery, read: Callable[[], DataFrame], messages: int | None = None, limit: float = 120.0) -> None:
    """Stops the stream when so many messages have met their end, or without a number, when a batch found no more of them and none waits
    in the state store, which has to count its rows. However long batches take, it gives up only when they go on for `limit` seconds
    without any change. (processAllAvailable() would wait for ever: timers always want a batch.)"""
    seen, since = 0, time.time()
    try:
        while q.isActive:
            if p := q.lastProgress:  # the folder is there after the first batch
                waiting = sum(s.numRowsTotal for s in p.stateOperators)
                if messages is None and p.numInputRows == 0 and waiting == 0:
                    return
                ended = 0 if messages is None else read().count()
                if messages is not None and ended >= messages:
                    return
                if ended > seen or p.numInputRows or any(s.numRowsUpdated or s.numRowsRemoved for s in p.stateOperators):
                    seen, since = ended, time.time()
                elif datetime.fromisoformat(p.timestamp).timestamp() > since + limit:  # when the last finished batch began
                    break
            time.sleep(0.3)
        raise q.exception() or TimeoutError("messages are still waiting")
    finally:
        q.stop()
