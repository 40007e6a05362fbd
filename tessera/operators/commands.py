"""Folds of command and event logs into state: toggles, statuses, offers, game ends, chats, moderation.

Each takes a log as a DataFrame and gives the state that its rows lead to, with windows and aggregates by
the state's key; a log may hold any number of rows a key. The SQL twins are written apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.presence import transitions
from tessera.operators.retrieval import tree_images
from tessera.registry import query


def toggles(log: DataFrame, key: list[str], on: str = "is_like", at: str = "ts") -> DataFrame:
    """key, is_active of the rows that a log of likes and unlikes leaves. An unlike without a row makes none."""
    made = log.groupBy(*key).agg(F.max_by(on, at).alias("is_active"), F.bool_or(on).alias("ever"))
    return made.where("ever").drop("ever")


def upsert_toggles(rows: DataFrame, log: DataFrame, key: list[str], on: str = "is_like", at: str = "ts") -> DataFrame:
    """rows(key, is_active) after the log: the last command of a key wins, new rows come with a like only."""
    last = log.groupBy(*key).agg(F.max_by(on, at).alias("last"), F.bool_or(on).alias("ever"))
    both = rows.join(last, key, "full").where("is_active is not null or ever")
    return both.select(*key, F.coalesce("last", "is_active").alias("is_active"))


_KEY = ["user_id", "post_id"]


def _halves(t) -> DataFrame:
    """What lies in the first half of the log's time as stored rows, toggled by the rest."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = t.post_like_events.agg(((F.min(at) + F.max(at)) / 2).alias("middle"))  # one row
    split = t.post_like_events.join(F.broadcast(middle)).withColumn("early", at <= F.col("middle"))
    return upsert_toggles(toggles(split.where("early"), _KEY), split.where("not early"), _KEY)


_LIKED = "select user_id, post_id, arg_max(is_like, ts) as is_active from post_like_events group by user_id, post_id having count(*) filter (where is_like) > 0"
query("win_like_last", _LIKED)(lambda t: toggles(t.post_like_events, _KEY))
query("dml_upsert_toggle", _LIKED)(_halves)


def statuses(log: DataFrame) -> DataFrame:
    """user_id, status of users with an open session at the end of log(user_id, ts, event_id, step, wanted).

    A connect (+1) makes ONLINE of a user without a status and leaves another status as it is; a request (step 0, wanted)
    counts only while a session is open; when the last session ends (-1), the status goes."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = log.withColumn("walk", F.sum("step").over(upto))
    x = x.withColumn("open", F.col("walk") - F.least(F.lit(0), F.min("walk").over(upto)))
    x = x.withColumn("before", F.coalesce(F.lag("open").over(order), F.lit(0)))
    x = x.withColumn("stay", F.sum(((F.col("before") == 0) & (F.col("open") > 0)).cast("int")).over(upto))
    taken = F.when((F.col("open") > 0) & (F.col("step") == 0), F.col("wanted"))
    stays = x.groupBy("user_id", "stay").agg(F.max_by("open", F.struct("ts", "event_id")).alias("open"), F.max_by(taken, F.when(taken.isNotNull(), F.struct("ts", "event_id"))).alias("status"))
    last = stays.groupBy("user_id").agg(F.max_by(F.struct("open", "status"), "stay").alias("last"))
    return last.where("last.open > 0").select("user_id", F.coalesce("last.status", F.lit("ONLINE")).alias("status"))


_STATUS_LOG = "select user_id, ts, event_id, case when event_type in ('view', 'click') then 1 when event_type = 'error' then -1 else 0 end as step, case when event_type = 'purchase' then 'PLAYING' when event_type = 'signup' then 'IN_ROOM' end as wanted from events"
query("st_set_status", f"""with l as ({_STATUS_LOG}),
w as (select *, sum(step) over (partition by user_id order by ts, event_id) as walk from l),
o as (select *, walk - least(0, min(walk) over (partition by user_id order by ts, event_id)) as open from w),
z as (select user_id, max((ts, event_id)) filter (where open = 0) as last_zero from o group by user_id),
e as (select o.* from o join z on z.user_id = o.user_id where z.last_zero is null or (o.ts, o.event_id) > z.last_zero)
select user_id, coalesce(arg_max(wanted, (ts, event_id)) filter (where wanted is not null), 'ONLINE') as status from e group by user_id""")(lambda t: statuses(t.sql(_STATUS_LOG)))


def accepted_offers(log: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """Of log(game_id, ply, at_ms) the offers that are set: an offer while one is open is ignored, and one is open for `ttl_ms`."""
    offers = F.sort_array(F.collect_list(F.struct("at_ms", "ply")))  # a game's offers, at most its moves
    none = F.array().cast("array<struct<at_ms: bigint, ply: bigint>>")
    took = F.aggregate(offers, none, lambda s, o: F.when((F.size(s) == 0) | (o["at_ms"] >= F.element_at(s, -1)["at_ms"] + ttl_ms), F.concat(s, F.array(o))).otherwise(s))
    return log.select("game_id", F.col("ply").cast("bigint").alias("ply"), F.col("at_ms").cast("bigint").alias("at_ms")).groupBy("game_id").agg(took.alias("took")).select("game_id", F.explode("took").alias("o")).select("game_id", "o.ply", "o.at_ms")


_OFFERS = "select game_id, ply, at_ms from (select game_id, ply, think_ms, cast(sum(least(think_ms, 12000)) over (partition by game_id order by ply) as bigint) as at_ms from moves) where think_ms > 60000"
query("st_draw_offer", f"""with recursive o as ({_OFFERS}), r as (
select game_id, min(at_ms) as at_ms from o group by game_id
union all select r.game_id, (select min(o.at_ms) from o where o.game_id = r.game_id and o.at_ms >= r.at_ms + 30000) as at_ms from r where r.at_ms is not null)
select o.game_id, cast(o.ply as bigint) as ply, o.at_ms from r join o on o.game_id = r.game_id and o.at_ms = r.at_ms""")(lambda t: accepted_offers(t.sql(_OFFERS)))


def resignations(log: DataFrame, games: DataFrame) -> DataFrame:
    """game_id, loser_id, winner_id from log(game_id, user_id, ts, event_id): the sender loses. Only players of a game in
    progress can resign, and a game ends once."""
    g = games.select(F.col("id").alias("game_id"), "white_id", "black_id", "status")
    sent = log.join(g, "game_id").where("status = 'IN_PROGRESS' and user_id in (white_id, black_id)")
    first = sent.groupBy("game_id").agg(F.min_by(F.struct("user_id", "white_id", "black_id"), F.struct("ts", "event_id")).alias("x"))
    return first.select("game_id", F.col("x.user_id").alias("loser_id"), F.when(F.col("x.user_id") == F.col("x.white_id"), F.col("x.black_id")).otherwise(F.col("x.white_id")).alias("winner_id"))


_RESIGN_LOG = "select e.event_id, e.ts, g.id as game_id, case e.event_id % 3 when 0 then g.white_id when 1 then g.black_id else e.user_id end as user_id from events e join games g on g.id = e.event_id % 400 where e.event_type <> 'view'"
_GAMES = "select id, white_id, black_id, case when id % 5 = 0 then 'FINISHED' else 'IN_PROGRESS' end as status from games"
query("st_resign", f"""select l.game_id, l.user_id as loser_id, case when l.user_id = g.white_id then g.black_id else g.white_id end as winner_id
from (select *, row_number() over (partition by game_id order by ts, event_id) as n from ({_RESIGN_LOG}) x where exists (select 1 from games y where y.id = x.game_id and x.user_id in (y.white_id, y.black_id))) l
join games g on g.id = l.game_id where n = 1 and g.id % 5 <> 0""")(lambda t: resignations(t.sql(_RESIGN_LOG), t.sql(_GAMES)))


def game_ends(rooms: DataFrame, log: DataFrame) -> DataFrame:
    """Rooms after log(room_id, ts, event_id, result, reason): the first end of a game in progress sets the room back to
    WAITING, nobody ready, and gives the game's row; any other end changes nothing."""
    first = log.groupBy("room_id").agg(F.min_by(F.struct("ts", "result", "reason"), F.struct("ts", "event_id")).alias("end"))
    out = rooms.join(first, "room_id", "left").withColumn("end", F.when(F.col("status") == "IN_PROGRESS", F.col("end")))
    ended = F.col("end").isNotNull()
    return out.select("room_id", F.when(ended, "WAITING").otherwise(F.col("status")).alias("status"), *[F.when(ended, False).otherwise(F.col(c)).alias(c) for c in ("white_ready", "black_ready")], F.col("end.ts").alias("ended_at"), "end.result", "end.reason")


_ENDS = "select event_id % 120 + 1 as room_id, ts, event_id, case event_id % 3 when 0 then 'WHITE_WIN' when 1 then 'BLACK_WIN' else 'DRAW' end as result, case event_type when 'error' then 'TIMEOUT' else 'CHECKMATE' end as reason from events where event_type in ('error', 'purchase')"
_READY = "select room_id, status, white_id is not null as white_ready, black_id is not null as black_ready from rooms"
query("st_game_end", f"""with e as (select * from (select *, row_number() over (partition by room_id order by ts, event_id) as n from ({_ENDS}) y) z where n = 1)
select r.room_id, case when e.room_id is not null then 'WAITING' else r.status end as status, white_ready and e.room_id is null as white_ready, black_ready and e.room_id is null as black_ready, e.ts as ended_at, e.result, e.reason
from ({_READY}) r left join e on e.room_id = r.room_id and r.status = 'IN_PROGRESS'""")(lambda t: game_ends(t.sql(_READY), t.sql(_ENDS)))


def chat_pushes(messages: DataFrame, rooms: DataFrame, keep: int = 10) -> DataFrame:
    """Outcome of each of messages(room_id, seq): NOT_FOUND without a room, FORBIDDEN while its settings lock the chat, else
    ACCEPTED; and whether it is among the `keep` newest accepted ones, which the list holds."""
    locked = F.coalesce(F.expr("try_variant_get(try_parse_json(settings), '$.chatLocked', 'boolean')"), F.lit(False))
    r = rooms.select("room_id", locked.alias("locked"))
    out = messages.join(r, "room_id", "left").withColumn("outcome", F.when(F.col("locked").isNull(), "NOT_FOUND").when(F.col("locked"), "FORBIDDEN").otherwise("ACCEPTED"))
    turn = F.row_number().over(Window.partitionBy("room_id", "outcome").orderBy(F.desc("seq")))
    return out.select("room_id", "seq", "outcome", ((F.col("outcome") == "ACCEPTED") & (turn <= keep)).alias("held"))


_LOCKS = "select room_id, case when room_id % 7 = 0 then '{\"chatLocked\":true}' when room_id % 7 = 1 then null else settings end as settings from rooms where room_id % 11 <> 3"
query("st_chat", f"""select m.room_id, m.seq, case when r.room_id is null then 'NOT_FOUND' when m.room_id % 7 = 0 then 'FORBIDDEN' else 'ACCEPTED' end as outcome,
 r.room_id is not null and m.room_id % 7 <> 0 and (select count(*) from room_chat n where n.room_id = m.room_id and n.seq > m.seq) < 3 as held
from room_chat m left join (select room_id from rooms where room_id % 11 <> 3) r on r.room_id = m.room_id""")(lambda t: chat_pushes(t.room_chat, t.sql(_LOCKS), keep=3))


def lobby_view(log: DataFrame) -> DataFrame:
    """Rooms that log(room_id, ts, event_id, kind) leaves in the lobby: their last event and the number since they were created.
    A delete takes a room out; an update of a room that isn't there does nothing."""
    order = Window.partitionBy("room_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = log.withColumn("life", F.last(F.when(F.col("kind").isin("create", "delete"), F.struct("kind", "ts", "event_id")), ignorenulls=True).over(order))
    lives = x.groupBy("room_id", "life").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("events"))
    newest = lives.groupBy("room_id").agg(F.max_by(F.struct("life", "last_event", "events"), F.struct("life.ts", "life.event_id")).alias("x"))
    return newest.where("x.life.kind = 'create'").select("room_id", "x.last_event", "x.events")


_LOBBY = "select event_id % 97 as room_id, ts, event_id, case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as kind from events"
query("st_lobby_feed", f"""with l as ({_LOBBY}), b as (select room_id, max((ts, event_id)) filter (where kind <> 'update') as since from l group by room_id)
select l.room_id, arg_max(l.kind, (l.ts, l.event_id)) as last_event, count(*) as events from l join b on b.room_id = l.room_id where (l.ts, l.event_id) >= b.since
group by l.room_id having arg_min(l.kind, (l.ts, l.event_id)) = 'create'""")(lambda t: lobby_view(t.sql(_LOBBY)))


def reduced_chat(log: DataFrame) -> DataFrame:
    """Messages that log(session_id, seq, op, message_id, content) leaves, in order: `put` appends a message or replaces the one
    with its id where it stands, `remove` takes it out."""
    order = Window.partitionBy("session_id", "message_id").orderBy("seq")
    removed = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-1))
    live = log.withColumn("removed", removed).where("op = 'put' and seq > removed")
    held = live.groupBy("session_id", "message_id").agg(F.min("seq").alias("stands"), F.max_by("content", "seq").alias("content"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("stands"))
    return held.select("session_id", "message_id", "content", place.cast("bigint").alias("place"))


_CHAT_OPS = "select session_id, seq, case when (session_id + seq) % 5 = 4 then 'remove' else 'put' end as op, seq * 3 % 4 as message_id, content from chat_messages"
query("st_chat_reducer", f"""with o as ({_CHAT_OPS}), p as (select * from o where op = 'put' and not exists (select 1 from o r where r.op = 'remove' and r.session_id = o.session_id and r.message_id = o.message_id and r.seq > o.seq))
select session_id, message_id, arg_max(content, seq) as content, row_number() over (partition by session_id order by min(seq)) as place from p group by session_id, message_id""")(lambda t: reduced_chat(t.sql(_CHAT_OPS)))


def offline_leaves(offline: DataFrame, presence: DataFrame) -> DataFrame:
    """A leave for each user of offline(user_id, ts) whose presence(user_id, status, room_id) says IN_ROOM; other users, and those
    without a room, get none."""
    held = presence.where("status = 'IN_ROOM' and room_id is not null")
    return offline.join(held, "user_id").select("room_id", "user_id", "ts", F.lit("leave").alias("action"), F.lit("DISCONNECT").alias("reason"))


_PRESENCE = "select id as user_id, case id % 3 when 0 then 'IN_ROOM' when 1 then 'PLAYING' else 'ONLINE' end as status, case when id % 4 <> 0 then id % 40 end as room_id from users where id < 150"
query("st_offline_leave", f"""with x as (select user_id, ts, event_id, sum(step) over (partition by user_id order by ts, event_id) as walk from presence_log),
y as (select user_id, ts, event_id, walk - least(0, min(walk) over (partition by user_id order by ts, event_id)) as open from x),
z as (select *, coalesce(lag(open) over (partition by user_id order by ts, event_id), 0) as before from y)
select user_id % 40 as room_id, user_id, ts, 'leave' as action, 'DISCONNECT' as reason from z where before > 0 and open = 0 and user_id % 3 = 0 and user_id % 4 <> 0 and user_id < 150 and user_id > 0""")(
    lambda t: offline_leaves(transitions(t.presence_log).where("status = 'OFFLINE'"), t.sql(_PRESENCE))
)


def moderated_once(posts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """posts(id, status) after verdicts(id, ts, event_id, verdict), which may come repeatedly: the first one for a post that is
    PENDING counts, later ones and those for other posts are skipped."""
    first = verdicts.where("verdict in ('APPROVED', 'DENIED')").groupBy("id").agg(F.min_by("verdict", F.struct("ts", "event_id")).alias("first"), F.count("*").alias("n"))
    open_ = (F.col("status") == "PENDING") & F.col("first").isNotNull()
    out = posts.join(first, "id", "left")
    return out.select("id", F.when(open_, F.col("first")).otherwise(F.col("status")).alias("status"), (F.coalesce("n", F.lit(0)) - open_.cast("int")).cast("bigint").alias("skipped"))


_VERDICTS = "select event_id % 300 as id, ts, event_id, case event_id % 4 when 0 then 'DENIED' when 1 then 'UNKNOWN' else 'APPROVED' end as verdict from events where event_type <> 'view'"
query("st_moderation_idempotent", f"""with v as (select * from ({_VERDICTS}) x where verdict <> 'UNKNOWN')
select p.id, case when p.status = 'PENDING' then coalesce((select arg_min(verdict, (ts, event_id)) from v where v.id = p.id), 'PENDING') else p.status end as status,
 (select count(*) from v where v.id = p.id) - case when p.status = 'PENDING' and exists (select 1 from v where v.id = p.id) then 1 else 0 end as skipped from posts p""")(
    lambda t: moderated_once(t.posts.select("id", "status"), t.sql(_VERDICTS))
)


def attached(images: DataFrame, bodies: DataFrame) -> DataFrame:
    """Orphan images that bodies(post_id, author_id, body) of their uploader show become attached to the post, the first one."""
    shown = bodies.select("post_id", "author_id", F.explode(tree_images("body")).alias("public_id"))
    first = shown.groupBy("public_id", F.col("author_id").alias("uploader_id")).agg(F.min("post_id").alias("new_post"))
    out = images.join(first, ["public_id", "uploader_id"], "left")
    hit = (F.col("status") == "ORPHAN") & F.col("new_post").isNotNull()
    return out.select("id", "public_id", F.when(hit, F.col("new_post")).otherwise(F.col("post_id")).alias("post_id"), F.when(hit, "ATTACHED").otherwise(F.col("status")).alias("status"))


_BODY = '\'{"type":"doc","content":[{"type":"p","content":[{"type":"image","attrs":{"data-public-id":"posts/images/%s"}}]},{"type":"image","attrs":{"data-public-id":"posts/images/%s"}}]}\''
query("join_image_attach", """select i.id, i.public_id, case when p.id is not null then p.id else i.post_id end as post_id, case when p.id is not null then 'ATTACHED' else i.status end as status
from post_images i left join (select x.i, x.uploader_id, min(x.id) as id from (select id as i, author_id as uploader_id, id from posts union all select id + 1 as i, author_id as uploader_id, id from posts) x group by x.i, x.uploader_id) p
on p.i = i.id and p.uploader_id = i.uploader_id and i.status = 'ORPHAN'""")(
    lambda t: attached(t.post_images, t.posts.select(F.col("id").alias("post_id"), "author_id", F.expr(f"format_string({_BODY}, id, id + 1)").alias("body")))
)


def valid_role(role: Column) -> Column:
    return F.coalesce(role.rlike("^(white|black|spectator)$"), F.lit(False))


_ROLES = "select event_id, case event_id % 7 when 0 then 'white' when 1 then 'black' when 2 then 'spectator' when 3 then 'White' when 4 then 'whites' when 5 then '' end as role from events"
query("filt_regex", f"select event_id, role from ({_ROLES}) x where regexp_full_match(role, 'white|black|spectator')")(lambda t: t.sql(_ROLES).where(valid_role(F.col("role"))))


def move_gaps(log: DataFrame) -> DataFrame:
    """room_id, event_id, gap_ms: the time since the room's move before; null for the first."""
    return log.select("room_id", "event_id", (F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy("room_id").orderBy("at_ms", "event_id"))).alias("gap_ms"))


query("win_turn_gap", """select a.room_id, a.event_id, a.at_ms - max(b.at_ms) as gap_ms from room_log a left join room_log b
on b.room_id = a.room_id and b.action = 'move' and (b.at_ms, b.event_id) < (a.at_ms, a.event_id) where a.action = 'move' group by a.room_id, a.event_id, a.at_ms""")(lambda t: move_gaps(t.room_log.where("action = 'move'")))


def progress(moves: DataFrame) -> DataFrame:
    """Of moves(user_id, period, phase, blunder, motif, remaining_ms, base_ms), by user and period: the share of blunders in each
    phase, the share of moves under time pressure (less than a tenth of the clock left), and the motif missed most often."""
    rate = lambda phase: F.avg(F.when(F.col("phase") == phase, F.col("blunder").cast("int"))).alias(f"{phase}_blunders")
    rates = moves.groupBy("user_id", "period").agg(*map(rate, ("opening", "middlegame", "endgame")), F.avg((10 * F.col("remaining_ms") < F.col("base_ms")).cast("int")).alias("time_pressure"))
    missed = moves.where("blunder").groupBy("user_id", "period", "motif").agg(F.count("*").alias("n"))
    top = missed.groupBy("user_id", "period").agg(F.min_by("motif", F.struct(-F.col("n"), "motif")).alias("top_missed"))
    return rates.join(top, ["user_id", "period"], "left")


_RATED = """select g.white_id as user_id, extract(month from g.start_time) as period, case when m.ply <= 2 then 'opening' when m.ply <= 4 then 'middlegame' else 'endgame' end as phase,
 m.think_ms % 7 = 0 as blunder, m.think_ms % 5 as motif, g.time_minutes * 60000 - m.think_ms * 4 as remaining_ms, g.time_minutes * 60000 as base_ms from moves m join games g on g.id = m.game_id"""
query("agg_progress", f"""with r as ({_RATED}), k as (select user_id, period, motif, row_number() over (partition by user_id, period order by count(*) desc, motif) as n from r where blunder group by user_id, period, motif)
select r.user_id, r.period, avg(case when blunder then 1.0 else 0.0 end) filter (where phase = 'opening') as opening_blunders, avg(case when blunder then 1.0 else 0.0 end) filter (where phase = 'middlegame') as middlegame_blunders,
 avg(case when blunder then 1.0 else 0.0 end) filter (where phase = 'endgame') as endgame_blunders, avg(case when remaining_ms * 10 < base_ms then 1.0 else 0.0 end) as time_pressure, max(k.motif) as top_missed
from r left join k on k.user_id = r.user_id and k.period = r.period and k.n = 1 group by r.user_id, r.period""")(lambda t: progress(t.sql(_RATED)))


def titles(sessions: DataFrame, messages: DataFrame, words: int = 6) -> DataFrame:
    """A session's own title, or the first words of its first message; quotes around it go."""
    first = messages.groupBy(F.col("session_id").alias("id")).agg(F.min_by("content", "seq").alias("content"))
    made = F.array_join(F.slice(F.split("content", " "), 1, words), " ")
    return sessions.join(first, "id", "left").select("id", F.regexp_replace(F.coalesce("title", made), "^[\"']+|[\"']+$", "").alias("title"))


_TITLED = "select id, case when id % 3 = 0 then concat('\"Session ''', cast(id as string), '''\"') end as title from chat_sessions"
query("chat_title", f"""select s.id, coalesce(trim(s.title, '"'''), trim(array_to_string(list_slice(string_split(m.content, ' '), 1, 6), ' '), '"''')) as title
from ({_TITLED}) s left join (select session_id, arg_min(content, seq) as content from chat_messages group by session_id) m on m.session_id = s.id""")(lambda t: titles(t.sql(_TITLED), t.chat_messages))


def inserted(rows: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """`rows` with `new` ones: a missing id is the next free one, missing times are `now`."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    numbered = new.withColumn("turn", F.row_number().over(Window.orderBy(*new.columns)))  # the rows of one command
    at = F.expr(f"timestamp_ntz '{now}'")
    filled = numbered.join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("turn")).withColumn("created_at", at)
    return rows.unionByName(filled.select(*rows.columns))


query("dml_insert", "select id, title, is_read, created_at from notifications union all select (select max(id) from notifications) + n, t, false, timestamp '2024-07-01 00:00:00' from (values (1, 'a'), (2, 'b')) v(n, t)")(
    lambda t: inserted(t.notifications.select("id", "title", "is_read", "created_at"), t.spark.createDataFrame([("b", False), ("a", False)], "title string, is_read boolean"), "2024-07-01 00:00:00")
)


def guest_names(guests: DataFrame, taken: DataFrame, attempts: int = 5, seed: str = "") -> DataFrame:
    """id, name: `guest_` and 8 characters drawn from the id, the attempt and `seed`, of the first attempt whose name neither stands
    in taken(name), nor went to a guest in an earlier attempt, nor goes to one with a smaller id in the same; null if none does. Guests
    with a name draw no more."""
    named = guests.select("id", F.lit(None).cast("string").alias("name")).where("id is not null").distinct()
    named = named.unionByName(taken.select(F.lit(None).cast(guests.schema["id"].dataType).alias("id"), "name").where("name is not null").distinct())
    for attempt in range(1, attempts + 1):
        drawn = F.concat(F.lit("guest_"), F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.lit(str(attempt)))), 1, 8))
        asked = named.withColumn("asked", F.coalesce("name", drawn))
        turn = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("name").isNull(), "id"))  # who has the name comes first
        named = asked.withColumn("turn", turn).select("id", F.when(F.col("turn") == 1, F.col("asked")).otherwise(F.col("name")).alias("name"))
    return guests.select("id").join(named.where("id is not null"), "id", "left")


_TAKEN = "select concat('guest_', substr(md5(concat('s:', cast(id as string), ':1')), 1, 8)) as name from users where id % 20 = 0"
query("fn_random", """select id, concat('guest_', substr(md5(concat('s:', id, case when id % 20 = 0 then ':2' else ':1' end)), 1, 8)) as name from users where role = 'GUEST'""")(
    lambda t: guest_names(t.users.where("role = 'GUEST'"), t.sql(_TAKEN), seed="s")
)
