"""Changes that last: the writes of the community as commits to stored tables, each read back afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.people import NOW, expired_guests
from tessera.registry import query
from tessera.sources.files import fresh_folder
from tessera.sources.stored import StoredTable, merged

MADE, CHANGED = "2024-08-01 00:00:00", "2024-09-01 00:00:00"


def _time(text: str) -> Column:
    return F.expr(f"timestamp_ntz '{text}'")


def _committed(t, rows: DataFrame, key: list[str], changes, **merge) -> DataFrame:
    """rows stored, changed by one commit that comes twice, and read. changes: a function of the stored rows."""
    table = StoredTable.create(rows, fresh_folder(t.spark, "stored"), key, 16, _time(MADE))
    found = changes(table.read())
    for _ in range(2):
        table.commit(found, merged(key, at=_time(CHANGED), **merge), batch=1)
    return table.read()


def like_log(t) -> DataFrame:
    """post_like_events with whether they lie in the first half of their time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = t.post_like_events.agg(((F.min(at) + F.max(at)) / 2).alias("middle"))  # one row
    return t.post_like_events.join(F.broadcast(middle)).withColumn("early", at <= F.col("middle"))


def _last(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "post_id").agg(F.max_by("is_like", "ts").alias("is_active"), F.bool_or("is_like").alias("ever"))


query("dml_commit_toggle", f"""with m as (select (epoch_us(min(ts)) + epoch_us(max(ts))) / 2 as middle from post_like_events),
s as (select user_id, post_id, arg_max(is_like, ts) as is_active from post_like_events, m where epoch_us(ts) <= middle group by user_id, post_id having bool_or(is_like)),
n as (select user_id, post_id, arg_max(is_like, ts) as is_active, bool_or(is_like) as ever from post_like_events, m where epoch_us(ts) > middle group by user_id, post_id)
select coalesce(s.user_id, n.user_id) as user_id, coalesce(s.post_id, n.post_id) as post_id, coalesce(n.is_active, s.is_active) as is_active, timestamp '{CHANGED}' - case when n.user_id is null then interval 31 days else interval 0 days end as updated_at
from s full join n on n.user_id = s.user_id and n.post_id = s.post_id where s.user_id is not null or n.ever""")(
    lambda t: _committed(t, _last(like_log(t).where("early")).where("ever").drop("ever"), ["user_id", "post_id"], lambda _: _last(like_log(t).where("not early")), values={"is_active": "new.is_active"}, insert="new.ever")
)
query("dml_commit_guarded", f"select id, case when status = 'PENDING' and id % 2 = 0 then 'APPROVED' else status end as status, case when status = 'PENDING' and id % 2 = 0 then timestamp '{CHANGED}' else timestamp '{MADE}' end as updated_at from posts")(
    lambda t: _committed(t, t.posts.select("id", "status"), ["id"], lambda p: p.where("id % 2 = 0").select("id"), values={"status": "'APPROVED'"}, when="old.status = 'PENDING'")
)
query("dml_commit_read", f"select id, recipient_id, is_read or recipient_id = 3 as is_read, case when recipient_id = 3 and not is_read then timestamp '{CHANGED}' else timestamp '{MADE}' end as updated_at from notifications")(
    lambda t: _committed(t, t.notifications.select("id", "recipient_id", "is_read"), ["id"], lambda n: n.where("recipient_id = 3 and not is_read").select("id"), values={"is_read": "true"})
)
query("dml_commit_delete", f"select id, role, timestamp '{MADE}' as updated_at from users where not (role = 'GUEST' and coalesce(last_seen, created_at) < timestamp '{NOW}' - interval 30 days)")(
    lambda t: _committed(t, t.users.select("id", "role", "last_seen", "created_at"), ["id"], lambda u: u.where(expired_guests(u, NOW)).select("id"), values={}, when="false", delete="true").select("id", "role", "updated_at")
)
