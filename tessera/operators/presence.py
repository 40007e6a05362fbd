"""Presence and event logs as batch queries: the twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import plain, query
from tessera.sources.files import fresh_folder
from tessera.streaming.live import PERIODS, presence_stream


def transitions(log: DataFrame) -> DataFrame:
    """log(user_id, ts, event_id, step +1 or -1): where the number of open sessions leaves 0 or comes back to it.

    A disconnect without an open session changes nothing, so the count is the running sum above its running minimum."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = log.withColumn("walk", F.sum("step").over(order))
    x = x.withColumn("open", F.col("walk") - F.least(F.lit(0), F.min("walk").over(order)))
    before = F.coalesce(F.lag("open").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0))
    x = x.withColumn("before", before)
    return x.where("(before = 0) <> (open = 0)").select("user_id", "ts", F.when(F.col("open") > 0, "ONLINE").otherwise("OFFLINE").alias("status"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's sessions: events less than `gap` apart."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


_WALK = """with x as (select user_id, ts, event_id, sum(step) over (partition by user_id order by ts, event_id) as walk from presence_log),
y as (select user_id, ts, event_id, walk - least(0, min(walk) over (partition by user_id order by ts, event_id)) as open from x),
z as (select *, coalesce(lag(open) over (partition by user_id order by ts, event_id), 0) as before from y)
"""
query("st_presence_connect", _WALK + "select user_id, ts, 'ONLINE' as status from z where before = 0 and open > 0")(lambda t: transitions(t.presence_log).where("status = 'ONLINE'"))
query("st_presence_disconnect", _WALK + "select user_id, ts, 'OFFLINE' as status from z where before > 0 and open = 0")(lambda t: transitions(t.presence_log).where("status = 'OFFLINE'"))
query("agg_online", _WALK + "select count(*) as online from (select user_id, max_by(open, (ts, event_id)) as open from z group by user_id) where open > 0")(
    lambda t: transitions(t.presence_log).groupBy("user_id").agg(F.max_by("status", "ts").alias("status")).where("status = 'ONLINE'").agg(F.count("*").alias("online"))
)
query("st_session_ttl", """with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) + interval 6 hours > ts then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as started, max(ts) + interval 6 hours as ended, count(*) as n from s group by user_id, k""")(lambda t: sessions(t.events, "6 hours"))


def _streamed(t) -> DataFrame:
    """Ends of the times online that the last watermark has passed, from the state machine run over the log as a stream."""
    folder = fresh_folder(t.spark, "presence")
    log = t.presence_events
    log.write.parquet(f"{folder}/in")
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    stream = presence_stream(t.spark.readStream.schema(log.schema).parquet(f"{folder}/in"), "10 seconds", changes=True)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    passed = t.spark.read.parquet(f"{folder}/in").agg((F.max("at_ms") - 10_000).alias("passed"))
    rows = t.spark.read.schema(stream.schema).parquet(f"{folder}/out").where("change = 'OFFLINE'").join(F.broadcast(passed), F.col("at_ms") <= F.col("passed"))
    return rows.select("user_id", F.col("at_ms").alias("ended_ms"), F.col("action").alias("cause"), "status", "room_id", "role")


_PERIODS = PERIODS.replace("{log}", "presence_events")
plain("st_presence_periods", _PERIODS)
query("st_presence_stream", f"select user_id, ended_ms, cause, status, room_id, role from ({_PERIODS}) x where ended_ms <= (select max(at_ms) - 10000 from presence_events)")(_streamed)
