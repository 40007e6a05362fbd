"""Results of the room log by kind of action: the batch form of the room stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import CODES, code_name
from tessera.registry import query
from tessera.streaming.rooms import fold

#: query -> actions whose results it gives.
ACTIONS = {
    "st_room_create": ("create",),
    "st_room_join": ("join",),
    "st_room_leave": ("leave",),
    "st_room_switch": ("switch",),
    "st_room_delete": ("delete",),
    "st_ready": ("ready", "unready"),
    "st_game_start": ("start",),
    "st_move": ("move", "timeout"),
    "st_draw_accept": ("accept_draw",),
    "st_draw_decline": ("decline_draw",),
    "st_playing_grace": ("drop",),
}

#: The same machine as a recursion over the numbered rows of each room, for another engine. A row takes three steps: two in which a
#: countdown or a clock can run out, and its own. Written from the rules, apart from the fold; covers the actions of the fixture log.
TWIN = """
with recursive l as (select *, row_number() over (partition by room_id order by at_ms, event_id) - 1 as n from room_log),
s as (
select room_id, cast(-1 as bigint) as i, false as e, cast(null as varchar) as st, cast(null as bigint) as h, cast(null as bigint) as w, cast(null as bigint) as b, false as wr, false as br,
  cast(null as bigint) as sa, cast(0 as bigint) as base, cast(0 as bigint) as inc, false as priv, false as sl, cast(null as varchar) as turn, cast(null as bigint) as ta, cast(null as bigint) as wms, cast(null as bigint) as bms,
  cast(0 as bigint) as ply, cast(null as bigint) as db, cast(0 as bigint) as du, cast(null as bigint) as late, cast([] as struct(u bigint, since bigint)[]) as spec,
  false as shown, cast(null as bigint) as o_event, cast(null as bigint) as o_at, cast(null as bigint) as o_user, cast(null as varchar) as o_action, cast(1 as int) as code, cast(null as varchar) as note,
  cast(null as varchar) as result, cast(null as varchar) as reason, cast(null as bigint) as grace
from (select distinct room_id from room_log) r
union all
select room_id, j, e1, st1, h1, w1, b1,
  case when cr or ended or (jn and role = 'white') or (gone_seat = 'white') or (sw and 'white' in (role, seat)) then false when rd and seat = 'white' then true else wr end,
  case when cr or ended or (jn and role = 'black') or (gone_seat = 'black') or (sw and 'black' in (role, seat)) then false when rd and seat = 'black' then true else br end,
  case when cr or ended or (lvp and st = 'COUNTDOWN') then null when counting then at_ms + 3000 else sa end,
  case when cr then coalesce(time_minutes, 10) * 60000 else base end, case when cr then coalesce(increment_seconds, 0) * 1000 else inc end, case when cr then is_private else priv end, case when cr then spectators_locked else sl end,
  case when cr or ended then null when fs then 'white' when mv then case turn when 'white' then 'black' else 'white' end else turn end,
  case when cr or ended then null when fs then sa when mv then at_ms else ta end,
  case when cr or ended then null when fs then base when mv and seat = 'white' then wms - greatest(0, at_ms - ta) + inc else wms end,
  case when cr or ended then null when fs then base when mv and seat = 'black' then bms - greatest(0, at_ms - ta) + inc else bms end,
  case when cr or fs then 0 when mv then ply + 1 else ply end,
  case when cr or ended then null when ofr then user_id when ev and action in ('accept_draw', 'decline_draw') and seat is not null and st = 'IN_PROGRESS' then null else db end,
  case when ofr then at_ms + 30000 else du end,
  case when cr or fs then null when ft then case turn when 'white' then w else b end else late end,
  case when gone then cast([] as struct(u bigint, since bigint)[]) else spec1 end,
  fs or ft or ev, case when ev then event_id end, case when ev then at_ms else deadline end, case when ev then user_id end, case when fs then 'start' when ft then 'timeout' else action end, code1, note1,
  case when ft then case turn when 'white' then 'BLACK_WIN' else 'WHITE_WIN' end when rs then case seat when 'white' then 'BLACK_WIN' else 'WHITE_WIN' end when acc then 'DRAW' end,
  case when ft then 'TIMEOUT' when rs then 'RESIGN' when acc then 'DRAW_AGREEMENT' end,
  case when dp then greatest(0, case seat when 'white' then wms else bms end - case when turn = seat then greatest(0, at_ms - ta) else 0 end) end
from (select *, case when cr then true when gone then false else e end as e1,
    case when cr or ended or (lvp and st = 'COUNTDOWN') then 'WAITING' when fs then 'IN_PROGRESS' when counting then 'COUNTDOWN' else st end as st1
  from (select *, coalesce(dl or note1 = 'ROOM_EMPTY', false) as gone
  from (select *, case when fs then 'GAME_STARTED' when cr then 'ROOM_CREATED' when jn then 'JOINED' when lvs then 'SPECTATOR_LEFT' when lvp and h <> user_id then 'PLAYER_LEFT' when lvp and h1 is null then 'ROOM_EMPTY'
      when lvp then 'HOST_TRANSFERRED' when sw then coalesce(seat, 'spectator') when counting then 'COUNTDOWN_STARTED' when mv or dp then seat when ofr then 'DRAW_OFFERED' when dec then 'DRAW_DECLINED' when dl then 'ROOM_DELETED' end as note1
  from (select *, case when cr then user_id when lvp and h = user_id then coalesce(w1, b1, (list_sort(list_transform(spec1, lambda z: struct_pack(a := z.since, u := z.u)))[1]).u) else h end as h1
  from (select *, case when lvp then seat end as gone_seat, fs is not null and (rs or acc or ft) as ended,
      rd and st = 'WAITING' and (wr or seat = 'white') and (br or seat = 'black') as counting,
      case when cr then case role when 'white' then user_id end when (jn or sw) and role = 'white' then user_id when (lvp or sw) and seat = 'white' then null else w end as w1,
      case when cr then case role when 'black' then user_id end when (jn or sw) and role = 'black' then user_id when (lvp or sw) and seat = 'black' then null else b end as b1,
      case when (lvs or lvp or (sw and seat is null)) and watched then others when jn and role = 'spectator' then list_append(others, struct_pack(u := user_id, since := at_ms)) else spec end as spec1
  from (select *, fire and st = 'COUNTDOWN' as fs, fire and st = 'IN_PROGRESS' as ft, ok and action = 'create' as cr, ok and action = 'join' as jn, ok and action = 'leave' and watched and h <> user_id as lvs,
      ok and action = 'leave' and not (watched and h <> user_id) as lvp, ok and action = 'switch' as sw, ok and action = 'ready' as rd, ok and action = 'move' as mv, ok and action = 'resign' as rs,
      ok and action = 'offer_draw' as ofr, ok and action = 'accept_draw' as acc, ok and action = 'decline_draw' as dec, ok and action = 'drop' as dp, ok and action = 'delete' as dl
  from (select *, ev and code1 = 1 as ok
  from (select *, not ev and e and coalesce(deadline <= at_ms, false) as fire, cast(case when not ev then 1
      when action = 'create' then case when e then -9 when not online then -8 when busy then -9 else 1 end
      when action = 'join' and not online then -8 when action = 'join' and busy then -9 when not e then -1
      when action = 'join' then case when st <> 'WAITING' and role <> 'spectator' then -2 when priv then -7 when seat is not null then -3 when taken then -4 when role = 'spectator' and sl then -5 else 1 end
      when action = 'leave' then case when watched then 1 when st = 'IN_PROGRESS' then -18 when seat is null and h <> user_id then -10 else 1 end
      when action = 'switch' then case when st <> 'WAITING' then -2 when seat is null and not watched then -10 when coalesce(seat, 'spectator') = role then -19 when taken then -4 else 1 end
      when action = 'ready' then case when st not in ('WAITING', 'COUNTDOWN') then -2 when seat is null then -12 else 1 end
      when action = 'move' then case when st <> 'IN_PROGRESS' and late = user_id then -17 when st <> 'IN_PROGRESS' then -16 when seat is null then -12 when seat <> turn then -15 else 1 end
      when action = 'delete' then 1
      when seat is null then -12 when st <> 'IN_PROGRESS' then 0 when action in ('resign', 'drop') then 1
      when action = 'offer_draw' then case when open_by is null then 1 else 0 end
      else case when open_by <> user_id then 1 else 0 end end as int) as code1
  from (select s.*, s.i + 1 as j, (s.i + 1) % 3 = 2 as ev, x.event_id, x.at_ms, x.user_id, x.action, x.role, x.online, x.busy, x.time_minutes, x.increment_seconds, x.is_private, x.spectators_locked,
      case when s.w = x.user_id then 'white' when s.b = x.user_id then 'black' end as seat, (x.role = 'white' and s.w is not null) or (x.role = 'black' and s.b is not null) as taken,
      list_contains(list_transform(s.spec, lambda z: z.u), x.user_id) as watched, list_filter(s.spec, lambda z: z.u <> x.user_id) as others, case when s.du > x.at_ms then s.db end as open_by,
      case s.st when 'COUNTDOWN' then s.sa when 'IN_PROGRESS' then s.ta + case s.turn when 'white' then s.wms else s.bms end end as deadline
    from s join l x on x.room_id = s.room_id and x.n = (s.i + 1) // 3))))))))))
select room_id, o_event as event_id, o_at as at_ms, o_user as user_id, o_action as action, code, note, case when e then st end as status, case when e then h end as host_id, case when e then w end as white_id, case when e then b end as black_id,
  case when e then turn end as turn, case when e then wms end as white_ms, case when e then bms end as black_ms, case when e then ply else 0 end as ply, result, reason, grace as grace_ms from s where shown and o_action in ({actions})"""

for _name, _actions in ACTIONS.items():
    query(_name, TWIN.replace("{actions}", ", ".join(f"'{a}'" for a in _actions)))(lambda t, actions=_actions: fold(t.room_log).where(F.col("action").isin(*actions)))

_CASES = " ".join(f"when {k} then '{v}'" for k, v in CODES.items())
query("fn_error_code", f"select event_id, case -(event_id % 21) when 0 then 'OK' {_CASES} else 'UNKNOWN' end as name from events")(lambda t: t.events.select("event_id", code_name(-(F.col("event_id") % 21)).alias("name")))
