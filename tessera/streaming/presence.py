"""Structured Streaming forms of the event-log queries. Their batch twins are in operators/presence.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files that arrive in a folder; `ts` becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def session_stream(events: DataFrame, gap: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    """A row per closed session of a user: a heartbeat renews it for `gap`."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Drops redelivered events."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
