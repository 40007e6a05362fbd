"""Sources, sinks and queues, each run over the test data and read back; and the small functions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lexemes, parse_uuid, uuid7
from tessera.operators.forum import _TOKENS
from tessera.operators.retrieval import CHUNKS, chunked, embed, sections, top_k_l2
from tessera.registry import plain, query
from tessera.sources.files import append, fresh_folder, is_seeded, markdown, truncate
from tessera.streaming.presence import events_stream
from tessera.streaming.retries import drain, retried, settled
from tessera.streaming.queues import after_commit, broadcast_to, consume, expired_keys, messages, publish, routed, store, with_dead_letters


def event_queue(t) -> DataFrame:
    """The events table as a queue."""
    return events_stream(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema).withColumn("routing_key", F.concat(F.lit("post."), "event_type"))


def stored(t, tag: str, rows: DataFrame, handle) -> DataFrame:
    """`rows` of a queue consumed by handle(folder); what the folder holds then."""
    folder = fresh_folder(t.spark, tag)
    consume(rows, handle(f"{folder}/out"), f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out")


def _refuse(_: DataFrame, __: int) -> None:
    raise ValueError("refused")


def _picky(body: str, attempt: int) -> None:
    """Refuses errors with an even number always, others once."""
    kind, number = body.split(" ")
    if kind == "error" and (int(number) % 2 == 0 or attempt == 1):
        raise ValueError(f"refused {number}")


def _each_tried(t) -> DataFrame:
    """The events as messages, each handled on its own."""
    folder = fresh_folder(t.spark, "retries")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t.spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "true")  # what drain() goes by
    messages = event_queue(t).select(F.col("event_id").alias("message_id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("body"))
    ends = retried(messages, _picky, pause=0.2)
    read = lambda: t.spark.read.schema(ends.schema).parquet(f"{folder}/out")
    drain(settled(ends, f"{folder}/out", f"{folder}/checkpoint"), read)
    return read().select(F.col("message_id").alias("event_id"), "outcome", "attempts", "error")


def _written(t, rows: DataFrame) -> DataFrame:
    folder = fresh_folder(t.spark, "table")
    append(rows, folder)
    return t.spark.read.schema(rows.schema).parquet(folder)


def _truncated(t) -> DataFrame:
    """Rows before and after, and columns after."""
    folder = fresh_folder(t.spark, "table")
    append(t.chunks, folder)
    before = t.spark.read.parquet(folder).count()
    truncate(t.spark, folder)
    left = t.spark.read.parquet(folder)
    return left.agg(F.lit(before).cast("bigint").alias("before"), F.count("*").alias("after"), F.lit(len(left.columns)).alias("columns"))


def _seeded(t) -> DataFrame:
    folder = fresh_folder(t.spark, "seed")
    before = is_seeded(t.spark, folder)
    append(t.chunks, folder)
    return t.spark.range(1).select(F.lit(before).alias("before"), F.lit(is_seeded(t.spark, folder)).alias("after"))


def _files(t) -> DataFrame:
    folder = fresh_folder(t.spark, "files")
    t.nation.select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(folder)
    found = markdown(t.spark, folder, "*.txt")
    return found.select(F.regexp_extract("source", r"n_nationkey=(\d+)/", 1).cast("int").alias("n_nationkey"), F.trim(F.regexp_replace("text", "\n", "")).alias("n_name"))


def _markdown(t) -> DataFrame:
    """Documents as Markdown files with two headings."""
    text = F.concat(F.lit("# Title\n"), "text", F.lit("\n## Notes\nend"))
    return t.documents.select(F.col("doc_id").cast("string").alias("source"), text.alias("text"))


query("source_queue", "select event_id, user_id, event_type from events where event_type <> 'error'")(
    lambda t: stored(t, "queue", routed(event_queue(t), "post.#").where("event_type <> 'error'"), lambda to: with_dead_letters(store(to), f"{to}-dead")).select("event_id", "user_id", "event_type")
)
query("sink_dlq", "select event_id, 'refused' as error from events where event_type = 'error'")(
    lambda t: stored(t, "dlq", routed(event_queue(t), "post.error"), lambda to: with_dead_letters(_refuse, to, pause=0.01)).select("event_id", "error")
)
query("sink_dlq_messages", """select event_id, case when event_type = 'error' and event_id % 2 = 0 then 'dead' else 'stored' end as outcome,
  cast(case when event_type <> 'error' then 1 when event_id % 2 = 0 then 3 else 2 end as int) as attempts, case when event_type = 'error' and event_id % 2 = 0 then concat('refused ', event_id) end as error from events""")(lambda t: _each_tried(t))
query("st_after_commit", "select event_id, concat('saved ', event_type) as message from events")(
    lambda t: stored(t, "commit", event_queue(t), lambda to: after_commit(f"{to}-data", to, lambda b: b.select("event_id", F.concat(F.lit("saved "), "event_type").alias("message")))).select("event_id", "message")
)
query("source_keyevent", """with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) + interval 6 hours > ts then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g), x as (select user_id, max(ts) + interval 6 hours as expired_at from s group by user_id, k)
select concat('user:', user_id, ':session') as key, expired_at from x where expired_at <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)""")(lambda t: _expired(t))
query("sink_broadcast", "select concat('/topic/user/', user_id) as topic, upper(event_type) as type, concat('{\"id\":', event_id, '}') as data from events")(
    lambda t: stored(t, "topics", event_queue(t).select(*messages("user", F.col("user_id"), F.upper("event_type"), F.struct(F.col("event_id").alias("id")))), broadcast_to).select("topic", "type", "data")
)
query("sink_publish", "select event_id, concat('post.', event_type) as routing_key, concat('{\"user\":', user_id, '}') as body from events where event_type in ('click', 'view')")(
    lambda t: stored(t, "published", event_queue(t).where("event_type <> 'purchase'"), lambda to: publish(to, "post.#", F.to_json(F.struct(F.col("user_id").alias("user"))))).where("event_type in ('click', 'view')").select("event_id", "routing_key", "body")
)
query("sink_insert", "select event_id, user_id, event_type from events")(lambda t: _written(t, t.events.select("event_id", "user_id", "event_type")))
query("sink_vector", "select id, label, cast(len(embedding) as bigint) as size from chunks")(lambda t: _written(t, t.chunks).select("id", "label", F.size("embedding").cast("bigint").alias("size")))
query("sink_truncate", "select (select count(*) from chunks) as before, cast(0 as bigint) as after, 3 as columns")(_truncated)
query("src_seeded", "select false as before, true as after")(_seeded)
query("scan_files", "select n_nationkey, n_name from nation")(_files)


def _expired(t) -> DataFrame:
    """Keys that expire within the log: a stream emits what its last watermark has passed."""
    folder = fresh_folder(t.spark, "keys")
    q = expired_keys(event_queue(t), "6 hours", "1 hour").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema("key string, expired_at timestamp").parquet(f"{folder}/out").withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz"))


query("doc_prefix", "select cast(doc_id as varchar) as source, unnest(['[Title]', '[Title > Notes]']) as prefix from documents")(lambda t: sections(_markdown(t)).select("source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("prefix")))
query("doc_metadata", CHUNKS + "select struct_pack(source := concat(id, '.md'), position := position) as metadata, substr(text, a + 1, z - a) as chunk from k where position >= 0")(lambda t: chunked(t.documents, "doc_id", "text").select(F.struct(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("source"), "position").alias("metadata"), "chunk"))
query("vec_embed", """with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')) as word from documents),
c as (select doc_id, cast(concat('0x', substr(md5(word), 1, 8)) as bigint) % 64 as cell, count(*) as n from w group by all), v as (select doc_id, sqrt(sum(n * n)) as norm from c group by doc_id)
select d.doc_id, (select list(round(coalesce((select max(c.n) from c where c.doc_id = d.doc_id and c.cell = k.k), 0) / coalesce(v.norm, 1), 3) order by k.k) from (select unnest(range(64)) as k) k) as embedding from documents d left join v on v.doc_id = d.doc_id""")(
    lambda t: embed(t.documents, "doc_id", "text", kind="double").select("doc_id", F.transform("embedding", lambda x: F.floor(x * 1000 + 0.5) / 1000).alias("embedding"))  # halves as SQL's round() takes them
)
_L2 = "round(list_distance(cast(c.embedding as double[]), cast(q.embedding as double[])), 4)"
query("vec_topk", f"select c.id, {_L2} as distance from chunks c, (select embedding from chunks where id = 0) q order by {_L2}, c.id limit 4")(
    lambda t: top_k_l2(t.chunks, t.chunks.where("id = 0").select("embedding")).select("id", F.round("distance", 4).alias("distance"))
)
query("fn_plainto", f"select id, cast(len({_TOKENS.format(x='line')}) as bigint) as n from (select id, concat(title, ' / ', status) as line from posts)")(
    lambda t: t.posts.select("id", F.size(lexemes(F.concat("title", F.lit(" / "), "status"))).cast("bigint").alias("n"))
)
_ID = "concat(lpad(cast(event_id as varchar), 8, '0'), case when event_id % 3 = 0 then '' else '-0000-7000-8000-0000000000AB' end)"
query("fn_parse_uuid", f"select event_id, case when regexp_full_match({_ID}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') then lower({_ID}) end as id from events")(
    lambda t: t.events.select("event_id", parse_uuid(F.expr(_ID.replace("varchar", "string"))).alias("id"))
)
query("fn_uuid7", "select room_id, created_at_ms as at_ms, '7' as version, true as well_formed from rooms")(
    lambda t: t.rooms.select("room_id", uuid7(F.col("created_at_ms")).alias("id")).select(
        "room_id", F.conv(F.concat(F.substring("id", 1, 8), F.substring("id", 10, 4)), 16, 10).cast("bigint").alias("at_ms"), F.substring("id", 15, 1).alias("version"), F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("well_formed")
    )
)
query("fn_json_root_check", "select id from (select id, case when id % 2 = 0 then '{\"type\":\"doc\"}' when id % 3 = 0 then '{\"type\":\"p\"}' else 'x' end as body from posts) where case when json_valid(body) then json_extract_string(body, '$.type') end = 'doc'")(
    lambda t: t.posts.withColumn("body", F.expr("case when id % 2 = 0 then '{\"type\":\"doc\"}' when id % 3 = 0 then '{\"type\":\"p\"}' else 'x' end")).where("try_variant_get(try_parse_json(body), '$.type', 'string') = 'doc'").select("id")
)
query("fn_hash_pairs", "select id, username as name, role from users")(
    lambda t: t.users.withColumn("flat", F.array(F.lit("name"), "username", F.lit("role"), "role"))
    .withColumn("m", F.expr("map_from_arrays(filter(flat, (x, i) -> i % 2 = 0), filter(flat, (x, i) -> i % 2 = 1))"))
    .select("id", F.expr("m['name']").alias("name"), F.expr("m['role']").alias("role"))
)
query("join_fetch", "select p.id, p.title, struct_pack(id := u.id, username := u.username, role := u.role) as author from posts p join users u on u.id = p.author_id where p.deleted_at is null and u.deleted_at is null")(
    lambda t: t.live_posts.alias("p").join(t.live_users.alias("u"), F.expr("u.id = p.author_id")).select("p.id", "p.title", F.struct("u.id", "u.username", "u.role").alias("author"))
)
for _name, _sql in {
    "proj_post_simple": "select p.id, p.title, p.status, p.view_count, p.created_at, u.id as author_id, u.username as author_username, u.avatar_url as author_avatar_url from posts p join users u on u.id = p.author_id where p.deleted_at is null",
    "set_add_remove": "select user_id, event_id % 50 as set_id from events group by user_id, event_id % 50 having max_by(event_type, (ts, event_id)) in ('view', 'click')",
}.items():
    if _name == "set_add_remove":
        query(_name, _sql)(lambda t: t.events.groupBy("user_id", (F.col("event_id") % 50).alias("set_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).where("last in ('view', 'click')").drop("last"))
    else:
        plain(_name, _sql)
