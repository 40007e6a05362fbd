"""Queues between services: routing, consumers with retries, outbox, expired keys, topics."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.streaming.presence import session_stream


def routed(rows: DataFrame, binding: str) -> DataFrame:
    """Rows whose routing_key fits a binding: words between dots, `*` for one word, `#` for any number of them."""
    parts = [{"*": r"\.[^.]+", "#": r"(\.[^.]+)*"}.get(w, rf"\.{re.escape(w)}") for w in binding.split(".")]
    return rows.where(F.concat(F.lit("."), "routing_key").rlike(f"^{''.join(parts)}$"))


def store(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that comes again, or a second attempt, replaces its rows."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def publish(folder: str, binding: str, body: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the messages whose routing_key fits the binding, with their body, partitioned by key."""
    return lambda batch, number: routed(batch, binding).withColumn("body", body).withColumn("topic", F.col("routing_key")).write.mode("overwrite").partitionBy("topic").parquet(f"{folder}/batch={number}")


def with_dead_letters(write: Callable[[DataFrame, int], None], dead: str, attempts: int = 3, pause: float = 1.0, factor: float = 2.0, most: float = 10.0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: tries write(batch, number) some times with growing pauses, then puts the batch under `dead` with its number;
    a rerun replaces it. `write` has to replace what an attempt before it left, as store() does."""

    def run(batch: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            try:
                write(batch, number)
                return
            except Exception as e:  # noqa: BLE001  any failure of the consumer counts
                error = str(e)[:500]
            if attempt < attempts - 1:
                time.sleep(min(most, pause * factor**attempt))
        batch.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return run


def consume(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes what has arrived in the queue, batch by batch; a batch is done when `handle` returns."""
    q = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def after_commit(data: str, outbox: str, message: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: messages are made from rows that are stored; a repeated batch replaces its rows and messages."""

    def run(batch: DataFrame, number: int) -> None:
        stored = f"{data}/batch={number}"
        batch.write.mode("overwrite").parquet(stored)
        message(batch.sparkSession.read.schema(batch.schema).parquet(stored)).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    return run


def expired_keys(events: DataFrame, ttl: str, late: str) -> DataFrame:
    """A key event for each session that no heartbeat renewed within `ttl`."""
    s = session_stream(events, ttl, late)
    return s.select(F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":session")).alias("key"), F.col("ended").alias("expired_at"))


def messages(kind: str, key: Column, type_: Column, data: Column) -> list[Column]:
    """Columns of a message to a topic. `kind` (room, lobby, user) partitions the sink: there are too many topics for that."""
    return [F.lit(kind).alias("kind"), F.concat(F.lit(f"/topic/{kind}/"), key.cast("string")).alias("topic"), type_.alias("type"), F.to_json(data).alias("data")]


def broadcast_to(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""
    return lambda batch, number: batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={number}")
