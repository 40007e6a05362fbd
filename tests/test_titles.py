from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import matches_all
from tessera.operators.titles import TitleIndex, trigrams


def test_trigrams(spark):
    rows = spark.createDataFrame([("Abcabc",), ("ab",), ("",), (None,), ("é😀xÉ",)], "t string").select(trigrams(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [["abc", "bca", "cab"], [], [], [], ["é😀x", "😀xé"]]


def test_index_against_scans(spark, tmp_path):
    titles = ["The white queen", "the WHITE knight", "Café on the white square", "knights", "", None, "white", "queen's white pawn"]
    posts = spark.createDataFrame([(i, titles[i % len(titles)]) for i in range(80)], "id long, title string")
    index = TitleIndex.create(posts, f"file://{tmp_path}/i", 32)

    def check(posts):
        for k in ("white", "queen WHITE", "cafe on", "nobody", "", "the the"):
            want = sorted(r.id for r in posts.where(matches_all(F.col("title"), k)).collect())
            assert sorted(r.id for r in index.with_words(k).collect()) == want, k
        for k in ("hite k", "QUEEN", "n", "ght", "zzz", "é on", "the white square and more"):
            want = sorted(r.id for r in posts.where(F.contains(F.lower("title"), F.lower(F.lit(k)))).collect())
            assert sorted(r.id for r in index.with_part(posts, k).collect()) == want, k

    check(posts)
    changed = posts.where("id < 20").select("id", F.col("title").alias("old_title"), F.when(F.col("id") % 3 == 0, F.lit("black queen")).when(F.col("id") % 3 == 1, F.concat_ws(" ", "title", F.lit("white"))).alias("title"))
    new = spark.createDataFrame([(100, None, "a white café")], changed.schema)
    for _ in range(2):  # a repeated batch changes nothing
        index.update(changed.unionByName(new), batch=3)
    check(posts.where("id >= 20").unionByName(changed.select("id", "title")).unionByName(new.select("id", "title")))


def test_a_search_reads_the_parts_of_its_terms(spark, tmp_path):
    posts = spark.createDataFrame([(i, f"word{i} other{i % 7} thing") for i in range(500)], "id long, title string")
    index = TitleIndex.create(posts, f"file://{tmp_path}/i", 32)
    whole = index.lists["lexemes"].read()
    asked = index.with_words("word33 other5")
    assert len(asked.inputFiles()) <= 2 < len(whole.inputFiles()) and [r.id for r in asked.collect()] == [33]
    part = index.with_part(posts, "ord33")
    assert 0 < part.count() < 20 and len([f for f in part.inputFiles()]) <= 3
