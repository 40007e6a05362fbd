"""Posts, comments and likes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lexemes, matches_all, unaccent
from tessera.registry import plain, query


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page counted from 0. The order must end in a unique column."""
    return df.orderBy(*order).offset(number * size).limit(size)


def with_counts(posts: DataFrame, likes: DataFrame, comments: DataFrame) -> DataFrame:
    """Adds like_count and comment_count. Both sides are summed by post before the join."""
    liked = likes.where("is_active").groupBy("post_id").agg(F.count("*").alias("like_count"))
    said = comments.where("deleted_at is null").groupBy("post_id").agg(F.count("*").alias("comment_count"))
    out = posts.join(liked, posts.id == liked.post_id, "left").drop("post_id").join(said, posts.id == said.post_id, "left").drop("post_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("like_count", "comment_count")})


def with_author(posts: DataFrame, users: DataFrame) -> DataFrame:
    authors = users.where("deleted_at is null").select(F.col("id").alias("author_id"), F.col("username").alias("author_username"), F.col("avatar_url").alias("author_avatar"))
    return posts.join(authors, "author_id")


def post_order(sort_by: str | None) -> list[Column]:
    """Unknown names mean newest first."""
    first = {"mostViewed": ["view_count"], "mostLiked": ["like_count", "view_count"]}.get(sort_by or "", [])
    return [F.desc(c) for c in (*first, "created_at", "id")]


SUMMARY = ["id", "author_id", "author_username", "title", "view_count", "like_count", "comment_count", "created_at"]


def listing(t, posts: DataFrame) -> DataFrame:
    return with_counts(with_author(posts, t.users), t.post_likes, t.comments).select(*SUMMARY)


def search(posts: DataFrame, keyword: str) -> DataFrame:
    """Word matches first (search_priority 1), then substring matches (2); each post once, with its best."""
    bare = unaccent(F.lit(keyword))
    words = posts.where(matches_all(F.col("title"), keyword)).withColumn("search_priority", F.lit(1))
    parts = posts.where(F.ilike(F.col("title"), F.concat(F.lit("%"), bare, F.lit("%")))).withColumn("search_priority", F.lit(2))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("search_priority"))
    return words.unionByName(parts).withColumn("turn", turn).where("turn = 1").drop("turn")


_LIST = """p.id, p.author_id, u.username as author_username, p.title, p.view_count,
 (select count(*) from post_likes pl where pl.post_id = p.id and pl.is_active) as like_count,
 (select count(*) from comments c where c.post_id = p.id and c.deleted_at is null) as comment_count, p.created_at
from posts p join users u on u.id = p.author_id and u.deleted_at is null where p.deleted_at is null"""


def approved(t) -> DataFrame:
    return t.live_posts.where("status = 'APPROVED'")


for _name, _sort, _order in (
    ("forum_approved_posts", "mostLiked", "like_count desc, view_count desc, created_at desc, id desc"),
    ("sort_case_param", "mostViewed", "view_count desc, created_at desc, id desc"),
    ("sort_created_desc", "newest", "created_at desc, id desc"),
):
    query(_name, f"select {_LIST} and p.status = 'APPROVED' order by {_order} limit 20")(lambda t, s=_sort: page(listing(t, approved(t)), 0, 20, *post_order(s)))

query("page_0based", f"select {_LIST} and p.status = 'APPROVED' order by p.created_at desc, p.id desc limit 20 offset 40")(lambda t: page(listing(t, approved(t)), 2, 20, *post_order(None)))
query("join_scalar_corr", f"select {_LIST}")(lambda t: listing(t, t.live_posts))


def my_posts(t, author: int, status: str | None, sort_by: str | None) -> DataFrame:
    mine = t.live_posts.where(F.col("author_id") == author)
    if status is not None:  # a predicate only if there is something to ask
        mine = mine.where(F.col("status") == status)
    return page(listing(t, mine), 0, 20, *post_order(sort_by))


query("filt_optional", f"select {_LIST} and p.author_id = 7 order by p.created_at desc, p.id desc limit 20")(lambda t: my_posts(t, 7, None, None))
query("sort_my_posts", f"select {_LIST} and p.author_id = 7 and p.status = 'PENDING' order by like_count desc, view_count desc, created_at desc, id desc limit 20")(lambda t: my_posts(t, 7, "PENDING", "mostLiked"))

KEYWORD = "thé on"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
_HIT = f"list_has_all({_TOKENS.format(x='p.title')}, {_TOKENS.format(x=repr(KEYWORD))})"
_LIKE = f"p.title ilike '%' || strip_accents('{KEYWORD}') || '%'"
query("filt_fts", f"select p.id from posts p where p.deleted_at is null and {_HIT}")(lambda t: t.live_posts.where(matches_all(F.col("title"), KEYWORD)).select("id"))
query("filt_ilike", f"select p.id from posts p where p.deleted_at is null and {_LIKE}")(lambda t: t.live_posts.where(F.ilike("title", F.concat(F.lit("%"), unaccent(F.lit(KEYWORD)), F.lit("%")))).select("id"))
query("win_distinct_on", f"select p.id, case when {_HIT} then 1 else 2 end as search_priority from posts p where p.deleted_at is null and p.status = 'APPROVED' and ({_HIT} or {_LIKE})")(lambda t: search(approved(t), KEYWORD).select("id", "search_priority"))
query("set_dedup", f"select case when {_HIT} then 1 else 2 end as search_priority, count(*) as n from posts p where p.deleted_at is null and ({_HIT} or {_LIKE}) group by 1")(lambda t: search(t.live_posts, KEYWORD).groupBy("search_priority").agg(F.count("*").alias("n")))
query("set_union_all", f"select p.id, 1 as search_priority from posts p where {_HIT} union all select p.id, 2 from posts p where {_LIKE}")(
    lambda t: t.posts.where(matches_all(F.col("title"), KEYWORD)).select("id", F.lit(1).alias("search_priority")).unionByName(t.posts.where(F.ilike("title", F.concat(F.lit("%"), unaccent(F.lit(KEYWORD)), F.lit("%")))).select("id", F.lit(2).alias("search_priority")))
)
query("set_or_search", f"select count(distinct p.id) as total from posts p where p.deleted_at is null and ({_HIT} or {_LIKE})")(lambda t: search(t.live_posts, KEYWORD).agg(F.countDistinct("id").alias("total")))
query("fn_unaccent", "select id, strip_accents(title) as plain from posts")(lambda t: t.posts.select("id", unaccent(F.col("title")).alias("plain")))
query("fn_tsvector", f"select p.id, cast(len({_TOKENS.format(x='p.title')}) as bigint) as n_lexemes from posts p")(lambda t: t.posts.select("id", F.size(lexemes(F.col("title"))).cast("bigint").alias("n_lexemes")))

query("join_semi_liked", "select p.id, p.id in (select post_id from post_likes where user_id = 5 and is_active) as liked from posts p where p.deleted_at is null")(
    lambda t: t.live_posts.join(t.post_likes.where("user_id = 5 and is_active").select(F.col("post_id").alias("id"), F.lit(True).alias("liked")).distinct(), "id", "left").select("id", F.coalesce("liked", F.lit(False)).alias("liked"))
)


def comments_with_likes(t, parent: Column, sort_by: str) -> DataFrame:
    """Comments with live authors, their like counts, and how many live replies each has."""
    if sort_by not in ("newest", "mostLiked"):
        raise ValueError(f"sort_by: {sort_by}")
    live = t.comments.where("deleted_at is null")
    likes = t.comment_likes.where("is_active").groupBy("comment_id").agg(F.count("*").alias("like_count"))
    replies = live.where("parent_id is not null").groupBy(F.col("parent_id").alias("of")).agg(F.count("*").alias("reply_count"))
    out = live.where(parent).join(t.users.select(F.col("id").alias("author_id"), "username"), "author_id")
    out = out.join(likes, out.id == likes.comment_id, "left").join(replies, out.id == replies.of, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("like_count", "reply_count")}
    return out.withColumns(zero).select("id", "post_id", "parent_id", "username", "like_count", "reply_count", "created_at")


_COMMENTS = """select c.id, c.post_id, c.parent_id, u.username, count(cl.user_id) as like_count,
 (select count(*) from comments r where r.parent_id = c.id and r.deleted_at is null) as reply_count, c.created_at
from comments c join users u on u.id = c.author_id left join comment_likes cl on cl.comment_id = c.id and cl.is_active
where c.deleted_at is null and {where} group by c.id, c.post_id, c.parent_id, u.username, c.created_at"""
query("agg_count_group", _COMMENTS.format(where="c.parent_id is null"))(lambda t: comments_with_likes(t, F.col("parent_id").isNull(), "newest"))
query("join_self", _COMMENTS.format(where="c.parent_id is not null"))(lambda t: comments_with_likes(t, F.col("parent_id").isNotNull(), "newest"))
query("sort_case_comments", _COMMENTS.format(where="c.post_id = 3 and c.parent_id is null") + " order by like_count desc, c.created_at desc limit 10")(
    lambda t: page(comments_with_likes(t, (F.col("post_id") == 3) & F.col("parent_id").isNull(), "mostLiked"), 0, 10, F.desc("like_count"), F.desc("created_at"))
)

for _name, _sql in {
    "scan_table": "select id, author_id, status, view_count from posts",
    "scan_by_id": "select id, username, role from users where id = 42",
    "proj_user_simple": "select id, username, avatar_url from users where deleted_at is null and id in (1, 2, 3, 5, 8)",
    "proj_post_content": "select title, content from posts where id = 11 and status = 'PENDING'",
    "proj_post_moderation": "select id, title, author_id, status from posts where id = 12",
    "proj_literal": "select id, 1 as search_priority from posts where status = 'DENIED'",
    "proj_flatten_parent": "select r.id, p.id as parent_id from comments r join comments p on p.id = r.parent_id",
    "filt_eq": "select id from posts where status = 'APPROVED' and author_id = 7",
    "filt_soft_delete": "select id from posts where deleted_at is null",
    "filt_in": "select user_id, post_id from post_likes where post_id in (1, 2, 3) and is_active",
    "filt_is_null_root": "select id from comments where parent_id is null and deleted_at is null",
    "filt_exists": "select u.id from users u where exists (select 1 from posts p where p.author_id = u.id and p.status = 'APPROVED' and p.deleted_at is null)",
    "filt_validation": "select id, length(trim(title)) > 0 and length(title) <= 100 as title_ok, length(trim(content)) > 0 and length(content) <= 10000 as content_ok from posts",
    "join_inner_author": "select p.id, u.username from posts p join users u on u.id = p.author_id where u.deleted_at is null and p.deleted_at is null",
    "join_left_on_cond": "select c.id, count(cl.user_id) as likes from comments c left join comment_likes cl on cl.comment_id = c.id and cl.is_active group by c.id",
    "join_map_default": "select c.id, coalesce(r.n, 0) as reply_count from comments c left join (select parent_id, count(*) as n from comments where parent_id is not null group by parent_id) r on r.parent_id = c.id",
    "agg_count_by_parent": "select parent_id, count(*) as n from comments where parent_id is not null and deleted_at is null group by parent_id",
    "agg_count_filtered": "select post_id, count(*) filter (where is_active) as likes from post_likes group by post_id",
    "agg_count_distinct": "select count(distinct author_id) as authors from posts where deleted_at is null",
    "agg_count_total": "select status, count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from posts where deleted_at is null group by status",
    "agg_distinct_set": "select distinct post_id from post_likes where user_id = 5 and is_active",
    "fn_concat": "select id, concat(title, ' / ', status) as line from posts",
    "fn_case_trim": "select id, upper(trim(status)) as up, lower(status) as low from posts",
    "sort_replies_id": "select id, parent_id from comments where parent_id = 300 order by id",
    "page_default": "select id from posts where deleted_at is null order by id limit 20",
}.items():
    plain(_name, _sql)

query("proj_nested", "select p.id, struct_pack(id := u.id, username := u.username) as author from posts p join users u on u.id = p.author_id")(
    lambda t: t.posts.select("id", "author_id").join(t.users.select(F.col("id").alias("author_id"), F.struct("id", "username").alias("author")), "author_id").select("id", "author")
)
