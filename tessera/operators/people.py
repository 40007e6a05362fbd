"""Users, notifications, images, and the writes that follow commands. Updates are copy-on-write projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.registry import plain, query


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New values where they are not null; `changes` has the key and some of the columns, one row a key."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def update_where(rows: DataFrame, guard: Column, **values: Column) -> DataFrame:
    return rows.withColumns({c: F.when(guard, v).otherwise(F.col(c)) for c, v in values.items()})


def moderate(posts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Applies verdicts(id, verdict) once: a post that is no longer pending keeps its status."""
    out = posts.join(verdicts.dropDuplicates(["id"]), "id", "left")
    guard = (F.col("status") == "PENDING") & F.col("verdict").isin("APPROVED", "DENIED")
    return out.withColumn("status", F.when(guard, F.col("verdict")).otherwise(F.col("status"))).drop("verdict")


def notices(moderated: DataFrame) -> DataFrame:
    """The notification that an author gets about a verdict."""
    title = F.when(F.col("status") == "APPROVED", F.lit("Post approved")).otherwise(F.lit("Post denied"))
    return moderated.where("status in ('APPROVED', 'DENIED')").select("id", F.col("author_id").alias("recipient_id"), title.alias("title"), F.format_string("\"%s\" is now %s", F.substring("title", 1, 20), F.lower("status")).alias("message"))


def expired_guests(users: DataFrame, now: str, days: int = 30) -> Column:
    return (F.col("role") == "GUEST") & (F.coalesce("last_seen", "created_at") < F.expr(f"timestamp_ntz '{now}' - interval {days} days"))


NOW = "2024-03-01 00:00:00"
query("proj_null_ignore_update", "select id, username, case when id % 2 = 0 then 'https://img.example/new.png' else avatar_url end as avatar_url from users")(
    lambda t: patch(t.users.select("id", "username", "avatar_url"), t.users.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("username"), F.lit("https://img.example/new.png").alias("avatar_url")), "id")
)
query("filt_or_null_fallback", f"select id from users where role = 'GUEST' and ((last_seen is not null and last_seen < timestamp '{NOW}' - interval 30 days) or (last_seen is null and created_at < timestamp '{NOW}' - interval 30 days))")(lambda t: t.users.where(expired_guests(t.users, NOW)).select("id"))
query("dml_delete_bulk", f"select id, role from users where not (role = 'GUEST' and coalesce(last_seen, created_at) < timestamp '{NOW}' - interval 30 days)")(lambda t: t.users.where(~expired_guests(t.users, NOW)).select("id", "role"))
query("filt_time_before", "select id, public_id from post_images where status = 'ORPHAN' and created_at < timestamp '2024-03-01 04:00:00' - interval 1 hour")(lambda t: t.post_images.where(F.expr("status = 'ORPHAN' and created_at < timestamp_ntz '2024-03-01 04:00:00' - interval 1 hour")).select("id", "public_id"))
query("fn_now_minus", f"select id, created_at - interval 1 hour as hour_before, cast(datediff('day', created_at, timestamp '{NOW}') as bigint) as days from users")(
    lambda t: t.users.select("id", F.expr("created_at - interval 1 hour").alias("hour_before"), F.datediff(F.expr(f"timestamp_ntz '{NOW}'"), "created_at").cast("bigint").alias("days"))
)
query("dml_attach", "select id, public_id, case when status = 'ORPHAN' and uploader_id = 9 and id in (9, 159) then 'ATTACHED' else status end as status from post_images")(
    lambda t: update_where(t.post_images, (F.col("status") == "ORPHAN") & (F.col("uploader_id") == 9) & F.col("id").isin(9, 159), status=F.lit("ATTACHED")).select("id", "public_id", "status")
)
query("dml_update_guarded", "select id, case when status = 'PENDING' and id % 2 = 0 then 'APPROVED' else status end as status from posts")(
    lambda t: moderate(t.posts, t.posts.where("id % 2 = 0").select("id", F.lit("APPROVED").alias("verdict"))).select("id", "status")
)
query("moderate_post", "select p.id, case when p.status = 'PENDING' then case when p.id % 3 = 0 then 'DENIED' else 'APPROVED' end else p.status end as status from posts p")(
    lambda t: moderate(t.posts, t.posts.select("id", F.expr("case when id % 3 = 0 then 'DENIED' else 'APPROVED' end").alias("verdict"))).select("id", "status")
)
query("notify_build", """select id, author_id as recipient_id, case when status = 'APPROVED' then 'Post approved' else 'Post denied' end as title,
 concat('"', substr(title, 1, 20), '" is now ', lower(status)) as message from posts where status in ('APPROVED', 'DENIED')""")(lambda t: notices(t.posts))
query("dml_increment", "select p.id, p.view_count + coalesce(v.n, 0) as view_count from posts p left join (select event_id % 50 as post_id, count(*) as n from events where event_type = 'view' group by 1) v on v.post_id = p.id")(
    lambda t: t.posts.select("id", "view_count").join(t.events.where("event_type = 'view'").groupBy((F.col("event_id") % 50).alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", (F.col("view_count") + F.coalesce("n", F.lit(0))).alias("view_count"))
)
query("dml_soft_delete", "select id, coalesce(deleted_at, case when id = 14 and author_id = 14 then timestamp '2024-07-01 00:00:00' end) as deleted_at from posts")(
    lambda t: update_where(t.posts, F.expr("id = 14 and author_id = 14 and deleted_at is null"), deleted_at=F.expr("timestamp_ntz '2024-07-01 00:00:00'")).select("id", "deleted_at")
)
query("dml_last_seen", "select u.id, greatest(u.last_seen, e.ts) as last_seen from users u left join (select user_id, max(ts) as ts from events where event_type = 'error' group by user_id) e on e.user_id = u.id")(
    lambda t: t.users.join(t.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("ts")), "id", "left").select("id", F.greatest("last_seen", "ts").alias("last_seen"))
)


def reply_verdicts(asked: DataFrame, comments: DataFrame, posts: DataFrame) -> DataFrame:
    """asked(ask_id, post_id, parent_id): why a reply is refused, null if it isn't."""
    c = comments.select(F.col("id").alias("c_id"), F.col("post_id").alias("c_post"), F.col("parent_id").alias("c_parent"))
    p = posts.select(F.col("id").alias("p_id"), F.col("status").alias("p_status"))
    out = asked.join(p, asked.post_id == p.p_id, "left").join(c, asked.parent_id == c.c_id, "left")
    why = F.when(F.coalesce("p_status", F.lit("")) != "APPROVED", "POST_NOT_APPROVED").when(F.col("parent_id").isNull(), F.lit(None)).when(F.col("c_id").isNull(), "PARENT_NOT_FOUND").when(F.col("c_post") != F.col("post_id"), "OTHER_POST").when(F.col("c_parent").isNotNull(), "PARENT_IS_REPLY")
    return out.select("ask_id", why.alias("refused"))


_ASKED = "select id as ask_id, case when id % 5 = 0 then post_id + 1 else post_id end as post_id, case when id % 7 = 0 then null when id % 11 = 0 then id + 50 else id end as parent_id from comments"
query("dml_insert_reply_rules", f"""select a.ask_id, case when coalesce(p.status, '') <> 'APPROVED' then 'POST_NOT_APPROVED' when a.parent_id is null then null when c.id is null then 'PARENT_NOT_FOUND'
 when c.post_id <> a.post_id then 'OTHER_POST' when c.parent_id is not null then 'PARENT_IS_REPLY' end as refused
from ({_ASKED}) a left join posts p on p.id = a.post_id left join comments c on c.id = a.parent_id""")(lambda t: reply_verdicts(t.sql(_ASKED), t.comments, t.posts))

for _name, _sql in {
    "agg_unread": "select recipient_id, count(*) filter (where not is_read) as unread from notifications group by recipient_id",
    "filt_bool": "select id from notifications where not is_read and recipient_id = 3",
    "sort_id_desc": "select id, title, is_read from notifications where recipient_id = 3 order by id desc limit 20",
    "dml_bulk_read": "select id, case when recipient_id = 3 then true else is_read end as is_read from notifications",
    "filt_compound_owner": "select id from post_images where public_id in ('posts/images/3', 'posts/images/6') and uploader_id = 3 and status = 'ORPHAN'",
    "join_union_dims": "select x.k, coalesce(a.id, b.id) as id from (select 'Customer#000000003' as k union all select 'https://img.example/5.png' as k) x left join users a on a.username = x.k left join users b on b.avatar_url = x.k",
    "proj_string_to_bool": "select id, coalesce(case when is_read then 'true' else 'no' end = 'true', false) as is_read from notifications",
    "fn_blank_null": "select id, nullif(trim(substr(title, 1, 1)), '') as head from posts",
    "fn_parse_long": "select event_id, coalesce(try_cast(case when event_id % 3 = 0 then event_type else cast(event_id as string) end as bigint), -1) as n from events",
    "fn_max0": "select id, greatest(0, view_count - 500) as over from posts",
    "fn_coalesce_role": "select id, coalesce(nullif(role, 'GUEST'), 'spectator') as role from users",
    "set_list_concat": "select room_id, user_id from spectators union select room_id, host_id from rooms union select room_id, white_id from rooms where white_id is not null union select room_id, black_id from rooms where black_id is not null",
}.items():
    plain(_name, _sql)
#: A session key; user keys and others don't fit. A session's name may hold colons.
EXPIRED_KEY = "^presence:session:([^:]+):(.+)$"
_EXPIRED = "case event_id % 4 when 0 then concat('presence:session:user', cast(user_id as string), ':sess', cast(event_id as string)) when 1 then concat('presence:session:user', cast(user_id as string), ':a:b:', cast(event_id as string)) when 2 then concat('presence:user:user', cast(user_id as string)) else 'presence:session:user' end"
query("fn_regex_expired_key", f"select event_id, case when k like 'presence:session:%:%' then split_part(k, ':', 3) end as user_key, case when k like 'presence:session:%:%' then substr(k, length('presence:session:' || split_part(k, ':', 3)) + 2) end as session_key from (select event_id, {_EXPIRED} as k from events)")(
    lambda t: t.events.select("event_id", F.expr(_EXPIRED).alias("k")).select("event_id", *[F.when(F.col("k").rlike(EXPIRED_KEY), F.regexp_extract("k", EXPIRED_KEY, i)).alias(c) for i, c in ((1, "user_key"), (2, "session_key"))])
)
query("fn_date_fmt", "select id, strftime(created_at, '%d/%m/%Y') as day from users")(lambda t: t.users.select("id", F.date_format("created_at", "dd/MM/yyyy").alias("day")))
query("fn_format", "select id, printf('%s (%s)', username, role) as label from users")(lambda t: t.users.select("id", F.format_string("%s (%s)", "username", "role").alias("label")))
query("fn_json_get", "select id, cast(json_extract_string(metadata, '$.k') as bigint) as k from notifications")(lambda t: t.notifications.select("id", F.expr("try_variant_get(try_parse_json(metadata), '$.k', 'bigint')").alias("k")))
query("fn_json_parse", "select id, case when json_valid(x) then json_extract_string(x, '$.k') end as k from (select id, case when id % 5 = 0 then 'not-json' else metadata end as x from notifications)")(
    lambda t: t.notifications.select("id", F.expr("case when id % 5 = 0 then 'not-json' else metadata end").alias("x")).select("id", F.expr("try_variant_get(try_parse_json(x), '$.k', 'string')").alias("k"))
)
query("filt_bad_json", "select id from notifications where id % 5 <> 0")(lambda t: t.notifications.withColumn("x", F.expr("case when id % 5 = 0 then 'not-json' else metadata end")).where(F.try_parse_json("x").isNotNull()).select("id"))
query("fn_json_write", "select id, concat('{\"id\":', id, ',\"role\":\"', role, '\"}') as json from users")(lambda t: t.users.select("id", F.to_json(F.struct("id", "role")).alias("json")))
