"""What a running or stopped stream holds, read from its checkpoint as tables: rooms, spectators, sessions and chats by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def state_of(spark: SparkSession, checkpoint: str, name: str, batch: int | None = None, operator: int = 0) -> DataFrame:
    """Columns of the key and of the value of a state variable; of a map also of its own key. As after a batch, the last by default."""
    read = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    found = (read if batch is None else read.option("batchId", batch)).load(checkpoint)
    return found.select(*[F.col(f"{c}.*") for c in found.columns if c in ("key", "user_map_key", "value", "user_map_value", "list_element")])


def live_rooms(spark: SparkSession, checkpoint: str, ids: DataFrame | None = None) -> DataFrame:
    """Rooms of a room stream; with ids(room_id) only those, and a row of nulls for each that isn't there."""
    rooms = state_of(spark, checkpoint, "room")
    return rooms if ids is None else ids.select("room_id").distinct().join(rooms, "room_id", "left")


def live_spectators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """room_id, user_id, since, place (from 0, first come first) and size (how many there are)."""
    every = Window.partitionBy("room_id")
    seen = state_of(spark, checkpoint, "spectators")
    return seen.withColumn("place", F.row_number().over(every.orderBy("since", "user_id")) - 1).withColumn("size", F.count("*").over(every))


def live_messages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, message_id, content, place of a stream of sessions' messages."""
    held = state_of(spark, checkpoint, "messages")
    return held.select("session_id", "message_id", "content", F.row_number().over(Window.partitionBy("session_id").orderBy("stands")).cast("bigint").alias("place"))
