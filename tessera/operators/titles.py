"""Search in titles through posting lists: lexemes for words, trigrams for parts of words, stored and kept up by batch.

A list is dealt to a part by its term, so that a search reads the parts of the terms asked for and no title but those it has to check.
All words of a keyword: the ids that stand in all of their lists. A part of a title: the ids in the lists of all trigrams of the keyword,
whose titles are then compared; a keyword of less than three characters has no trigram, and all titles are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import lexemes, unaccent
from tessera.operators.forum import _HIT, _LIKE, KEYWORD
from tessera.registry import query
from tessera.sources.files import fresh_folder
from tessera.sources.stored import StoredTable


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters of the text in lower case."""
    low = F.lower(x)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


TERMS = {"lexemes": lexemes, "trigrams": trigrams}


def postings(posts: DataFrame, terms) -> DataFrame:
    """(term, id) of posts(id, title)."""
    return posts.where("id is not null and title is not null").select(F.explode(terms(F.col("title"))).alias("term"), F.col("id").cast("long").alias("id")).distinct()


def _changed(old: DataFrame, changes: DataFrame) -> DataFrame:
    """old(term, id) without the postings that go and with those that come."""
    gone = changes.where("not comes").select("term", "id")
    came = changes.where("comes").select("term", "id", F.current_timestamp().alias("updated_at"))
    return old.join(changes.select("term", "id"), ["term", "id"], "left_anti").select("term", "id", "updated_at").unionByName(came.join(gone, ["term", "id"], "left_anti"))


class TitleIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.lists = spark, {kind: StoredTable(spark, f"{folder}/{kind}") for kind in TERMS}

    @classmethod
    def create(cls, posts: DataFrame, folder: str, parts: int = 64) -> TitleIndex:
        for kind, terms in TERMS.items():
            StoredTable.create(postings(posts, terms), f"{folder}/{kind}", ["term"], parts)
        return cls(posts.sparkSession, folder)

    def update(self, changes: DataFrame, batch: int | None = None) -> None:
        """changes: id, old_title (null for a new post), title (null for one that goes); a row a post."""
        for kind, terms in TERMS.items():
            was, is_ = (postings(changes.select("id", F.col(c).alias("title")), terms) for c in ("old_title", "title"))
            net = was.join(is_, ["term", "id"], "left_anti").withColumn("comes", F.lit(False)).unionByName(is_.join(was, ["term", "id"], "left_anti").withColumn("comes", F.lit(True)))
            self.lists[kind].commit(net, _changed, batch)

    def _in_all(self, kind: str, terms: Column) -> DataFrame | None:
        """Ids in the lists of all terms; None without a term."""
        asked = self.spark.range(1).select(F.explode(terms).alias("term"))
        n = asked.count()
        if not n:
            return None
        found = self.lists[kind].read_for(asked).join(F.broadcast(asked), "term", "left_semi")  # as many terms as a keyword has
        return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("id")

    def with_words(self, keyword: str) -> DataFrame:
        """Ids of titles with every word of the keyword; none without words."""
        found = self._in_all("lexemes", lexemes(F.lit(keyword)))
        return self.spark.createDataFrame([], "id long") if found is None else found

    def with_part(self, posts: DataFrame, part: str) -> DataFrame:
        """posts whose title holds the part, in any case."""
        near = self._in_all("trigrams", trigrams(F.lit(part)))
        some = posts if near is None else posts.join(near, "id", "left_semi")
        return some.where(F.contains(F.lower("title"), F.lower(F.lit(part))))


def _index(t) -> TitleIndex:
    """Of the live posts, whose odd ids come by an update, after another title of theirs."""
    posts = t.live_posts.select("id", "title")
    index = TitleIndex.create(posts.withColumn("title", F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.lit("thé on old title"))), fresh_folder(t.spark, "titles"), 16)
    index.update(posts.where("id % 2 = 1").select("id", F.lit("thé on old title").alias("old_title"), "title"), batch=1)
    return index


query("fn_trigram", "select id, cast(case when length(title) < 3 then 0 else len(list_distinct(list_transform(range(1, length(title) - 1), lambda i: substr(lower(title), i, 3)))) end as bigint) as n_trigrams from posts where title is not null")(
    lambda t: t.posts.where("title is not null").select("id", F.size(trigrams(F.col("title"))).cast("bigint").alias("n_trigrams"))
)
query("filt_fts_index", f"select p.id from posts p where p.deleted_at is null and {_HIT}")(lambda t: _index(t).with_words(KEYWORD).select("id"))
query("filt_ilike_index", f"select p.id from posts p where p.deleted_at is null and {_LIKE}")(lambda t: _index(t).with_part(t.live_posts, t.spark.range(1).select(unaccent(F.lit(KEYWORD))).first()[0]).select("id"))
