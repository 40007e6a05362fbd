"""The folds of command logs on small logs whose outcome is plain."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tessera.operators import commands as c
from tessera.operators.people import EXPIRED_KEY
from tessera.operators.retrieval import embed
from tessera.streaming.queues import with_dead_letters


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_toggles(spark):
    log = spark.createDataFrame([(1, 1, False, 1), (1, 2, True, 2), (1, 2, False, 3), (1, 3, True, 4)], "user_id long, post_id long, is_like boolean, ts long")
    assert rows(c.toggles(log, ["user_id", "post_id"])) == [(1, 2, False), (1, 3, True)]
    old = spark.createDataFrame([(1, 1, True), (9, 9, True)], "user_id long, post_id long, is_active boolean")
    assert rows(c.upsert_toggles(old, log, ["user_id", "post_id"])) == [(1, 1, False), (1, 2, False), (1, 3, True), (9, 9, True)]


def test_statuses(spark):
    log = [
        (1, 1, 0, "PLAYING"),  # no session yet
        (1, 2, 1, None),
        (2, 1, 1, None), (2, 2, 0, "PLAYING"), (2, 3, 1, None),  # a second connect leaves PLAYING
        (3, 1, 1, None), (3, 2, 0, "PLAYING"), (3, 3, -1, None), (3, 4, 1, None),  # the status went with the session
        (4, 1, 1, None), (4, 2, -1, None),
        (5, 1, -1, None), (5, 2, 1, None), (5, 3, 0, "IN_ROOM"),  # a disconnect without a session
    ]
    df = spark.createDataFrame([(u, t, t, s, w) for u, t, s, w in log], "user_id long, ts long, event_id long, step int, wanted string")
    assert rows(c.statuses(df)) == [(1, "ONLINE"), (2, "PLAYING"), (3, "ONLINE"), (5, "IN_ROOM")]


def test_draw_offers(spark):
    log = spark.createDataFrame([(1, 1, 0), (1, 2, 29_999), (1, 3, 30_000), (1, 4, 59_999), (1, 5, 90_000), (2, 8, 5)], "game_id long, ply long, at_ms long")
    assert rows(c.accepted_offers(log)) == [(1, 1, 0), (1, 3, 30_000), (1, 5, 90_000), (2, 8, 5)]


def test_resign_and_end(spark):
    games = spark.createDataFrame([(1, 10, 11, "IN_PROGRESS"), (2, 20, 21, "FINISHED"), (3, 30, 31, "IN_PROGRESS")], "id long, white_id long, black_id long, status string")
    log = spark.createDataFrame([(1, 99, 1, 1), (1, 11, 2, 2), (1, 10, 3, 3), (2, 20, 1, 4), (3, 30, 1, 5)], "game_id long, user_id long, ts long, event_id long")
    assert rows(c.resignations(log, games)) == [(1, 11, 10), (3, 30, 31)]
    rooms = spark.createDataFrame([(1, "IN_PROGRESS", True, True), (2, "WAITING", True, False)], "room_id long, status string, white_ready boolean, black_ready boolean")
    ends = spark.createDataFrame([(1, 5, 1, "DRAW", "DRAW_AGREEMENT"), (1, 4, 2, "WHITE_WIN", "RESIGN"), (2, 1, 3, "DRAW", "X")], "room_id long, ts long, event_id long, result string, reason string")
    assert rows(c.game_ends(rooms, ends)) == [(1, "WAITING", False, False, 4, "WHITE_WIN", "RESIGN"), (2, "WAITING", True, False, None, None, None)]


def test_chat_lock_and_trim(spark):
    rooms = spark.createDataFrame([(1, '{"chatLocked":true}'), (2, "{}"), (3, None), (4, "not json")], "room_id long, settings string")
    messages = spark.createDataFrame([(r, s) for r in range(1, 6) for s in range(12)], "room_id long, seq long")
    got = {(r.room_id, r.seq): (r.outcome, r.held) for r in c.chat_pushes(messages, rooms).collect()}
    assert got[1, 11] == ("FORBIDDEN", False) and got[5, 11] == ("NOT_FOUND", False)
    assert [s for s in range(12) if got[2, s] == ("ACCEPTED", True)] == list(range(2, 12)) and got[3, 0] == ("ACCEPTED", False) and got[4, 5][0] == "ACCEPTED"


def test_lobby(spark):
    log = [(1, 1, "create"), (1, 2, "update"), (2, 1, "create"), (2, 2, "delete"), (2, 3, "update"), (3, 1, "update"), (4, 1, "delete"), (4, 2, "create")]
    df = spark.createDataFrame([(r, t, t, k) for r, t, k in log], "room_id long, ts long, event_id long, kind string")
    assert rows(c.lobby_view(df)) == [(1, "update", 2), (4, "create", 1)]


def test_chat_reducer(spark):
    log = [(1, "put", "a", "1"), (2, "put", "b", "2"), (3, "put", "a", "1b"), (4, "remove", "b", None), (5, "put", "c", "3"), (6, "put", "b", "4"), (7, "remove", "x", None)]
    df = spark.createDataFrame([(7, s, o, m, t) for s, o, m, t in log], "session_id long, seq long, op string, message_id string, content string")
    assert [tuple(r) for r in c.reduced_chat(df).orderBy("place").select("message_id", "content").collect()] == [("a", "1b"), ("c", "3"), ("b", "4")]


def test_offline_routing(spark):
    offline = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "user_id long, ts long")
    presence = spark.createDataFrame([(1, "IN_ROOM", "room1"), (2, "ONLINE", "room1"), (3, "IN_ROOM", None)], "user_id long, status string, room_id string")
    assert rows(c.offline_leaves(offline, presence)) == [("room1", 1, 5, "leave", "DISCONNECT")]


def test_moderation_counts_once(spark):
    posts = spark.createDataFrame([(1, "PENDING"), (2, "APPROVED"), (3, "PENDING")], "id long, status string")
    verdicts = spark.createDataFrame([(1, 2, 1, "APPROVED"), (1, 1, 2, "DENIED"), (1, 1, 2, "DENIED"), (2, 1, 3, "DENIED"), (3, 1, 4, "UNSURE")], "id long, ts long, event_id long, verdict string")
    assert rows(c.moderated_once(posts, verdicts)) == [(1, "DENIED", 2), (2, "APPROVED", 1), (3, "PENDING", 0)]


def test_images_and_titles(spark):
    tree = '{"type":"doc","content":[{"type":"image","attrs":{"data-public-id":"%s"}}]}'
    images = spark.createDataFrame([(1, "a", 7, None, "ORPHAN"), (2, "b", 8, None, "ORPHAN"), (3, "c", 7, 4, "ATTACHED")], "id long, public_id string, uploader_id long, post_id long, status string")
    bodies = spark.createDataFrame([(20, 7, tree % "a"), (21, 7, tree % "a"), (22, 7, tree % "b"), (23, 7, tree % "c"), (24, 7, "not json")], "post_id long, author_id long, body string")
    assert rows(c.attached(images, bodies)) == [(1, "a", 20, "ATTACHED"), (2, "b", None, "ORPHAN"), (3, "c", 4, "ATTACHED")]
    sessions = spark.createDataFrame([(1, '"Openings"'), (2, None), (3, None)], "id long, title string")
    messages = spark.createDataFrame([(2, 1, "later"), (2, 0, '"How do I castle on the long side?"')], "session_id long, seq long, content string")
    assert rows(c.titles(sessions, messages)) == [(1, "Openings"), (2, "How do I castle on the"), (3, None)]


def test_guest_names_are_unique(spark):
    guests = spark.range(300).toDF("id")
    taken = c.guest_names(guests, spark.createDataFrame([], "name string")).where("id < 100").select("name")
    again = c.guest_names(guests, taken)
    names = {r.id: r.name for r in again.collect()}
    assert len(set(names.values())) == 300 and not {r.name for r in taken.collect()} & set(names.values())
    assert names == {r.id: r.name for r in c.guest_names(guests, taken).collect()}


def test_guests_with_a_name_draw_no_more(spark):
    """39780 and 852650 draw the same second name; 39780 has its first, 852650 doesn't."""
    name = lambda i, attempt: "guest_" + hashlib.md5(f"s:{i}:{attempt}".encode()).hexdigest()[:8]
    assert name(39780, 2) == name(852650, 2)
    guests = spark.createDataFrame([(39780,), (852650,)], "id long")
    taken = spark.createDataFrame([(name(852650, 1),), (None,)], "name string")
    assert rows(c.guest_names(guests, taken, seed="s")) == [(39780, name(39780, 1)), (852650, name(852650, 2))]
    taken = spark.createDataFrame([(name(852650, 1),), (name(39780, 1),)], "name string")  # now both ask for it
    assert rows(c.guest_names(guests, taken, seed="s")) == [(39780, name(39780, 2)), (852650, name(852650, 3))]


def test_inserts_fill_defaults(spark):
    old = spark.createDataFrame([(5, "x")], "id long, title string").selectExpr("id", "title", "timestamp_ntz '2020-01-01' as created_at")
    new = spark.createDataFrame([("b",), ("a",)], "title string")
    assert [(r.id, r.title, str(r.created_at)[:4]) for r in c.inserted(old, new, "2024-07-01").orderBy("id").collect()] == [(5, "x", "2020"), (6, "a", "2024"), (7, "b", "2024")]


@pytest.mark.parametrize(("key", "want"), [("presence:session:user123:sess456", ("user123", "sess456")), ("presence:session:u:a:b", ("u", "a:b")), ("presence:user:user123", None), ("presence:session:u", None)])
def test_expired_key(key, want):
    import re

    m = re.search(EXPIRED_KEY, key)
    assert (m.groups() if m else None) == want


def test_embedding(spark):
    df = spark.createDataFrame([(1, "One two two"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in embed(df, "id", "text", 32).collect()}
    assert sorted(got[1][got[1] > 0].round(4).tolist()) == [0.4472, 0.8944] and not got[2].any() and not got[3].any() and len(got[2]) == 32


def test_a_second_attempt_replaces_the_first(spark, tmp_path):
    tries = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        tries.append(number)
        if len(tries) < 2:
            raise ValueError("after writing")

    with_dead_letters(write, f"{tmp_path}/dead", pause=0.01)(spark.range(5), 3)
    assert tries == [3, 3] and spark.read.parquet(f"{tmp_path}/out").count() == 5
