"""Rooms, lobby, live chat and games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import plain, query


def hydrated(rooms: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the names of host, white and black; a seat without a user stays null."""
    for role in ("host", "white", "black"):
        names = users.select(F.col("id").alias(f"{role}_id"), F.col("username").alias(f"{role}_name"))
        rooms = rooms.join(names, f"{role}_id", "left")
    return rooms


def lobby(rooms: DataFrame, text: str, page: int, size: int) -> DataFrame:
    """Rooms whose name holds `text`, newest first: a page, with the number of all matches."""
    hits = rooms.where(F.lower("name").contains(text.lower()))
    total = hits.agg(F.count("*").alias("matched"))  # one row
    shown = hits.orderBy(F.desc("created_at_ms"), F.desc("room_id")).offset(page * size).limit(size)
    return shown.join(F.broadcast(total)).select("room_id", "name", "matched")


def last_messages(chat: DataFrame, key: str, order: str, n: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return chat.withColumn("newest", turn).where(F.col("newest") <= n)


def remaining_clock(moves: DataFrame, games: DataFrame) -> DataFrame:
    """Milliseconds left after each move of a colour; a player at 0 or less has lost on time."""
    mine = Window.partitionBy("game_id", "is_white").orderBy("ply").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = games.select(F.col("id").alias("game_id"), "time_minutes", "increment_seconds")
    x = moves.withColumn("is_white", F.col("ply") % 2).join(g, "game_id")
    return x.select("game_id", "ply", "is_white", (F.col("time_minutes") * 60000 + F.sum(F.col("increment_seconds") * 1000 - F.col("think_ms")).over(mine)).alias("remaining_ms"))


def timeouts(moves: DataFrame, games: DataFrame) -> DataFrame:
    """The first move of a game that leaves its player no time."""
    late = remaining_clock(moves, games).where("remaining_ms <= 0")
    return late.groupBy("game_id").agg(F.min_by("is_white", "ply").alias("loser_is_white"), F.min("ply").alias("ply"))


def move_text(moves: DataFrame) -> DataFrame:
    """`1. a b 2. c ...` of each game; a move is shown by its think time here."""
    word = F.concat(F.when(F.col("ply") % 2 == 1, F.concat(F.floor((F.col("ply") + 1) / 2).cast("string"), F.lit(". "))).otherwise(F.lit("")), F.lit("m"), F.col("think_ms").cast("string"))
    cells = F.sort_array(F.collect_list(F.struct("ply", word.alias("word"))))
    return moves.groupBy("game_id").agg(F.concat_ws(" ", F.transform(cells, lambda c: c["word"])).alias("moves"))


def winner(result: Column) -> Column:
    return F.when(result == "WHITE_WIN", "white").when(result == "BLACK_WIN", "black")


query("join_hydrate", """select r.room_id, h.username as host_name, w.username as white_name, b.username as black_name from rooms r
left join users h on h.id = r.host_id left join users w on w.id = r.white_id left join users b on b.id = r.black_id""")(lambda t: hydrated(t.rooms, t.users).select("room_id", "host_name", "white_name", "black_name"))
query("agg_lobby_matched", "select room_id, name, count(*) over () as matched from rooms where contains(lower(name), '00') order by created_at_ms desc, room_id desc limit 5")(lambda t: lobby(t.rooms, "00", 0, 5))
query("win_page_index", "select room_id, name, (select count(*) from rooms where contains(lower(name), '1')) as matched from (select * from rooms where contains(lower(name), '1') order by created_at_ms desc, room_id desc limit 3 offset 3)")(lambda t: lobby(t.rooms, "1", 1, 3))
query("win_last_n_chat", "select room_id, seq, message from (select *, row_number() over (partition by room_id order by seq desc) as n from room_chat) where n <= 10")(lambda t: last_messages(t.room_chat, "room_id", "seq", 10).select("room_id", "seq", "message"))
query("win_running_clock", "select m.game_id, m.ply, m.ply % 2 as is_white, g.time_minutes * 60000 + sum(g.increment_seconds * 1000 - m.think_ms) over (partition by m.game_id, m.ply % 2 order by m.ply) as remaining_ms from moves m join games g on g.id = m.game_id")(lambda t: remaining_clock(t.moves, t.games))
query("st_turn_timer", """with c as (select m.game_id, m.ply, m.ply % 2 as is_white, g.time_minutes * 60000 + sum(g.increment_seconds * 1000 - m.think_ms) over (partition by m.game_id, m.ply % 2 order by m.ply) as remaining_ms
 from moves m join games g on g.id = m.game_id) select game_id, min_by(is_white, ply) as loser_is_white, min(ply) as ply from c where remaining_ms <= 0 group by game_id""")(lambda t: timeouts(t.moves, t.games))
query("agg_concat_moves", "select game_id, string_agg(case when ply % 2 = 1 then cast((ply + 1) // 2 as varchar) || '. ' else '' end || 'm' || think_ms, ' ' order by ply) as moves from moves group by game_id")(lambda t: move_text(t.moves))
query("agg_sum_clock", "select game_id, cast(sum(think_ms) filter (where ply % 2 = 1) as bigint) as white_ms, cast(sum(think_ms) filter (where ply % 2 = 0) as bigint) as black_ms from moves group by game_id")(
    lambda t: t.moves.groupBy("game_id").agg(F.sum(F.when(F.col("ply") % 2 == 1, F.col("think_ms"))).alias("white_ms"), F.sum(F.when(F.col("ply") % 2 == 0, F.col("think_ms"))).alias("black_ms"))
)
query("fn_result", "select id, case result when 'WHITE_WIN' then 'white' when 'BLACK_WIN' then 'black' end as winner, case result when 'WHITE_WIN' then 'black' when 'BLACK_WIN' then 'white' end as loser from games")(
    lambda t: t.games.select("id", winner(F.col("result")).alias("winner"), F.when(F.col("result") == "WHITE_WIN", "black").when(F.col("result") == "BLACK_WIN", "white").alias("loser"))
)
query("proj_default", "select room_id, coalesce(cast(json_extract(settings, '$.timeMinutes') as int), 10) as time_minutes, coalesce(cast(json_extract(settings, '$.incrementSeconds') as int), 0) as increment_seconds, coalesce(json_extract_string(settings, '$.variant'), 'STANDARD') as variant from rooms")(
    lambda t: t.rooms.withColumn("s", F.try_parse_json("settings")).select("room_id", *[F.expr(f"coalesce(try_variant_get(s, '$.{k}', '{ty}'), {d})").alias(a) for k, ty, d, a in (("timeMinutes", "int", "10", "time_minutes"), ("incrementSeconds", "int", "0", "increment_seconds"), ("variant", "string", "'STANDARD'", "variant"))])
)
query("filt_privacy", "select room_id from rooms where not cast(json_extract(settings, '$.isPrivate') as boolean) or 9 in (host_id, white_id, black_id)")(
    lambda t: t.rooms.where(F.expr("not try_variant_get(try_parse_json(settings), '$.isPrivate', 'boolean') or host_id = 9 or coalesce(white_id = 9, false) or coalesce(black_id = 9, false)")).select("room_id")
)
query("fn_epoch", "select room_id, make_timestamp(created_at_ms * 1000) as created_at from rooms")(lambda t: t.rooms.select("room_id", F.timestamp_millis("created_at_ms").cast("timestamp_ntz").alias("created_at")))
query("agg_min_score", "select room_id, min_by(user_id, (joined_at, user_id)) as next_host from spectators group by room_id")(lambda t: t.spectators.groupBy("room_id").agg(F.min_by("user_id", F.struct("joined_at", "user_id")).alias("next_host")))
query("list_trim", "select room_id, list_slice(list(seq order by seq desc), 1, 3) as newest from room_chat group by room_id")(lambda t: last_messages(t.room_chat, "room_id", "seq", 3).groupBy("room_id").agg(F.sort_array(F.collect_list("seq"), False).alias("newest")))
query("list_reverse", "select room_id, list(seq order by seq) as oldest_first from room_chat group by room_id")(lambda t: t.room_chat.groupBy("room_id").agg(F.reverse(F.sort_array(F.collect_list("seq"), False)).alias("oldest_first")))
query("agg_distinct_list", "select host_id, list(room_id order by room_id) as rooms from rooms group by host_id")(lambda t: t.rooms.groupBy("host_id").agg(F.sort_array(F.array_distinct(F.collect_list("room_id"))).alias("rooms")))
query("fn_ceil_page", "select status, cast(ceil(count(*) / 7.0) as bigint) as pages from rooms group by status")(lambda t: t.rooms.groupBy("status").agg(F.ceil(F.count("*") / 7.0).cast("bigint").alias("pages")))

for _name, _sql in {
    "scan_hash": "select * from rooms where room_id = 4",
    "scan_hash_batch": "select room_id, name, status from rooms where room_id in (1, 4, 9)",
    "scan_hmget": "select host_id, white_id, black_id from rooms where room_id = 4",
    "scan_list": "select seq, message from room_chat where room_id = 2 order by seq",
    "scan_zset_rank": "select room_id, user_id, joined_at as score, row_number() over (partition by room_id order by joined_at, user_id) - 1 as rank, count(*) over (partition by room_id) as size from spectators",
    "scan_zset_range": "select room_id, user_id, joined_at from (select room_id, user_id, joined_at, row_number() over (partition by room_id order by joined_at, user_id) - 1 as rank from spectators) x where rank between 2 and 4",
    "scan_zset": "select room_id, created_at_ms from rooms order by created_at_ms desc, room_id desc limit 10",
    "sort_zrev": "select room_id, user_id, joined_at from spectators where room_id = 1 order by joined_at desc, user_id desc limit 10",
    "filt_substring_ci": "select room_id from rooms where contains(lower(name), '#00000000')",
    "join_anti_hydrate_drop": "select s.room_id, s.user_id, u.username from spectators s join rooms r on r.room_id = s.room_id join users u on u.id = s.user_id",
    "agg_zcard": "select room_id, count(*) as spectators from spectators group by room_id",
    "win_move_number": "select game_id, ply, cast(floor((ply - 1) / 2) as bigint) + 1 as move_number from moves",
    "fn_unit": "select id, time_minutes * 60 * 1000 as base_ms, increment_seconds * 1000 as increment_ms from games",
    "fn_turn_flip": "select game_id, ply, case when ply % 2 = 1 then 'black' else 'white' end as next_turn from moves",
}.items():
    plain(_name, _sql)
