"""The community's tables, mapped onto the star schema, documents and events of the test data."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: {TS} is the type of a literal without time zone.
VIEWS: dict[str, str] = {
    "users": """
select c_custkey as id, c_name as username, concat('https://img.example/', cast(c_custkey as string), '.png') as avatar_url,
  case when c_custkey = 1 then 'SUPERUSER' when c_custkey % 10 = 0 then 'GUEST' when c_custkey % 50 = 2 then 'ADMIN' else 'USER' end as role,
  c_custkey % 31 <> 0 as is_active, {TS} '2024-01-01 00:00:00' + interval '1' minute * c_custkey as created_at,
  case when c_custkey % 4 <> 0 then {TS} '2024-01-10 00:00:00' + interval '1' hour * (c_custkey % 400) end as last_seen,
  case when c_custkey % 17 = 5 then {TS} '2024-06-01 00:00:00' end as deleted_at
from customer""",
    "posts": """
select d.doc_id as id, d.doc_id % 150 as author_id, substr(d.text, 1, 100) as title, d.text as content,
  case when l.toxic = 1 then 'DENIED' when l.toxic = 0 then 'APPROVED' else 'PENDING' end as status, d.n_chars as view_count,
  {TS} '2024-01-01 00:00:00' + interval '1' minute * d.doc_id as created_at,
  case when d.doc_id % 29 = 3 then {TS} '2024-06-01 00:00:00' end as deleted_at
from documents d left join labels l on l.doc_id = d.doc_id""",
    "comments": """
select conv_id * 100 + turn as id, conv_id as post_id, (conv_id * 7 + turn * 3) % 150 as author_id,
  case when turn % 3 = 0 then null else conv_id * 100 + turn - turn % 3 end as parent_id, text as content,
  {TS} '2024-02-01 00:00:00' + interval '1' second * (conv_id * 1000 + turn) as created_at,
  case when (conv_id + turn) % 11 = 7 then {TS} '2024-06-01 00:00:00' end as deleted_at
from conversations""",
    "post_like_events": "select event_id, user_id, event_id % 50 as post_id, event_type = 'click' as is_like, ts from events where event_type in ('click', 'view')",
    "comment_like_events": "select event_id, user_id, (event_id % 100) * 100 + event_id % 5 as comment_id, event_type = 'purchase' as is_like, ts from events where event_type in ('purchase', 'signup')",
    "post_likes": "select user_id, post_id, max_by(is_like, ts) as is_active from post_like_events group by user_id, post_id having max(case when is_like then 1 else 0 end) = 1",
    "comment_likes": "select user_id, comment_id, max_by(is_like, ts) as is_active from comment_like_events group by user_id, comment_id having max(case when is_like then 1 else 0 end) = 1",
    "notifications": """
select event_id as id, case when event_id % 3 = 0 then null else event_id % 150 end as sender_id, user_id as recipient_id, 'SYSTEM_MESSAGE' as type,
  concat(event_type, ' #', cast(event_id as string)) as title, props as metadata, value < 10 as is_read, ts as created_at
from events""",
    "post_images": """
select page_id as id, case when page_id % 3 = 0 then null else page_id end as post_id, page_id % 150 as uploader_id, url,
  concat('posts/images/', cast(page_id as string)) as public_id, case when page_id % 3 = 0 then 'ORPHAN' else 'ATTACHED' end as status,
  {TS} '2024-03-01 00:00:00' + interval '1' minute * page_id as created_at
from pages""",
    "games": """
select o_orderkey as id, o_custkey as white_id, (o_custkey + 1 + o_orderkey % 100) % 150 as black_id, o_orderdate as start_time,
  o_orderdate + interval '1' second * (60 + o_orderkey % 1800) as end_time,
  case when o_orderkey % 3 = 0 then 3 when o_orderkey % 3 = 1 then 10 else 15 end as time_minutes, cast(o_orderkey % 4 as int) as increment_seconds,
  'FINISHED' as status, case o_orderstatus when 'O' then 'WHITE_WIN' when 'F' then 'BLACK_WIN' else 'DRAW' end as result,
  case when o_orderstatus = 'P' then case when o_orderkey % 2 = 0 then 'STALEMATE' else 'DRAW_AGREEMENT' end
       else case o_orderpriority when '1-URGENT' then 'TIMEOUT' when '2-HIGH' then 'RESIGN' else 'CHECKMATE' end end as result_reason
from orders""",
    "moves": """
select l_orderkey as game_id, row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) as ply,
  cast(l_quantity * 4000 as bigint) as think_ms
from lineitem""",
    "rooms": """
select s_suppkey as room_id, s_name as name, s_suppkey % 150 as host_id, case when s_suppkey % 2 = 0 then s_suppkey % 150 end as white_id,
  case when s_suppkey % 2 = 1 then s_suppkey % 150 when s_suppkey % 4 = 0 then (s_suppkey + 7) % 150 end as black_id,
  case when s_suppkey % 4 = 0 then 'IN_PROGRESS' else 'WAITING' end as status,
  concat('{"timeMinutes":', cast(3 + s_suppkey % 3 as string), ',"isPrivate":', case when s_suppkey % 9 = 0 then 'true' else 'false' end, '}') as settings,
  1718029381000 + s_suppkey * 1000 as created_at_ms
from supplier""",
    "spectators": "select event_id % 100 + 1 as room_id, user_id, min(ts) as joined_at from events where event_type = 'view' group by event_id % 100 + 1, user_id",
    "room_chat": "select conv_id as room_id, turn as seq, (conv_id + turn) % 150 as sender_id, text as message from conversations",
    "chat_sessions": """
select conv_id as id, conv_id % 20 as user_id, max(turn) + 1 as n_messages, {TS} '2024-04-01 00:00:00' + interval '1' minute * conv_id as created_at
from conversations group by conv_id""",
    "chat_messages": "select conv_id as session_id, turn as seq, role, text as content from conversations",
    "chunks": "select vec_id as id, embedding, label from embeddings",
    "room_log": """
select room_id, event_id, at_ms, case action when 'join' then room_id * 10 + 2 when 'watch' then room_id * 10 + 3 else room_id * 10 + 1 + (step + case when event_id % 7 = 6 then 1 else 0 end) % 2 end as user_id,
  case action when 'watch' then 'join' else action end as action, case action when 'create' then 'white' when 'join' then 'black' when 'watch' then 'spectator' when 'switch' then 'white' end as role,
  event_type <> 'error' as online, event_id % 19 = 7 as busy, cast(1 + room_id % 3 as int) as time_minutes, cast(room_id % 4 as int) as increment_seconds, room_id % 9 = 0 as is_private, room_id % 5 = 0 as spectators_locked
from (select event_id, event_type, cast(floor(event_id / 300) as bigint) as room_id, event_id % 15 as step,
    1718029381000 + event_id * 4000 + event_id * 7919 % 3000 as at_ms,
    case event_id % 15 when 0 then 'create' when 1 then 'join' when 2 then 'ready' when 3 then 'ready' when 9 then 'offer_draw' when 10 then case cast(floor(event_id / 15) as bigint) % 3 when 0 then 'accept_draw' when 1 then 'decline_draw' else 'resign' end
      when 8 then 'drop' when 11 then 'watch' when 12 then 'switch' when 13 then 'leave' when 14 then case when event_id % 4 = 0 then 'delete' else 'leave' end else 'move' end as action from events) x""",
    "presence_events": """
select user_id, event_id, 1718029381000 + event_id * 7919 % 1000 * 600 as at_ms, concat('s', cast(event_id * 31 % 3 as string)) as session_id,
  case event_id % 8 when 0 then 'connect' when 1 then 'connect' when 5 then 'disconnect' when 6 then 'status' else 'heartbeat' end as action,
  case when event_id % 8 = 6 then case cast(floor(event_id / 8) as bigint) % 3 when 0 then 'IN_ROOM' when 1 then 'PLAYING' else 'ONLINE' end end as status,
  case when event_id % 8 = 6 and event_id % 5 <> 0 then event_id % 40 end as room_id, case when event_id % 7 = 0 then null when event_id % 2 = 0 then 'white' else 'black' end as role,
  5000 + event_id * 37 % 40000 as grace_ms
from events""",
    "presence_log": "select user_id, ts, case when event_type in ('view', 'click') then 1 else -1 end as step, event_type, event_id from events",
}


def _needs(sql: str) -> list[str]:
    """The views that `sql` reads, each behind the ones that it reads itself."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in [*_needs(VIEWS[name]), name] if x not in found]
    return found


def with_views(sql: str, ts: str) -> str:
    """`sql` with the fixture views that it reads as common table expressions before it."""
    heads = ", ".join(f"{n} as ({VIEWS[n].replace('{TS}', ts).strip()})" for n in _needs(sql))
    sql = sql.replace("{TS}", ts).strip()
    if not heads:
        return sql
    for word in ("with recursive ", "with "):
        if sql.startswith(word):
            return f"{word}{heads}, {sql[len(word) :]}"
    return f"with {heads} {sql}"


class Tables:
    """Tables and fixture views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = with_views(text, "timestamp_ntz")
        for name in BASE:
            if re.search(rf"\b{name}\b", text):
                self.base(name).createOrReplaceTempView(name)  # bound when the text is analysed
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    @cached_property
    def live_users(self) -> DataFrame:
        return self.users.where("deleted_at is null")

    @cached_property
    def live_posts(self) -> DataFrame:
        return self.posts.where("deleted_at is null")
