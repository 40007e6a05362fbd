from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.text import uuid7
from tessera.operators.people import patch
from tessera.operators.presence import sessions
from tessera.operators.retrieval import embed, image_ids, sections, split_text
from tessera.sources.files import append, is_seeded, markdown, truncate
from tessera.streaming.presence import events_stream, session_stream
from tessera.streaming.queues import routed, with_dead_letters


def test_sessions_of_stream_and_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = session_stream(events_stream(spark, f"{tmp_path}/in", events.schema), "6 hours", "1 hour")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = sessions(events.withColumn("ts", events.ts.cast("timestamp")), "6 hours")
    passed = events.selectExpr("date_trunc('millisecond', cast(max(ts) as timestamp)) - interval 1 hour").first()[0]  # the last watermark
    want = {(r.user_id, str(r.started), r.n) for r in batch.collect() if r.ended <= passed}
    assert want and {(r.user_id, str(r.started), r.n) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()} == want


def test_dead_letters(spark, tmp_path):
    def fail(_, __):
        raise ValueError("no")

    with_dead_letters(fail, f"{tmp_path}/dead", pause=0.01)(spark.range(3), 7)
    assert spark.read.parquet(f"{tmp_path}/dead").where("batch = 7 and error = 'no'").count() == 3


def test_routed(spark):
    keys = spark.createDataFrame([("post",), ("post.a",), ("post.a.b",), ("postal.a",), ("x.post",)], "routing_key string")
    found = {b: [r[0] for r in routed(keys, b).orderBy("routing_key").collect()] for b in ("post.#", "post.*", "#", "*.post")}
    assert found == {"post.#": ["post", "post.a", "post.a.b"], "post.*": ["post.a"], "#": ["post", "post.a", "post.a.b", "postal.a", "x.post"], "*.post": ["x.post"]}


def test_embed(spark):
    docs = spark.createDataFrame([(0, ""), (1, None), (2, "One two ONE")], "id long, t string")
    rows = [(r.embedding,) for r in embed(docs, "id", "t", 16).orderBy("id").collect()]
    want = [0.0] * 16
    for w in ("one", "two", "one"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert [rows[0][0], rows[1][0]] == [[0.0] * 16] * 2 and rows[2][0] == pytest.approx([x / norm for x in want])


def test_embeddings_at_halves_are_rounded_as_in_sql(spark, tmp_path):
    """Lengths of 80 and 400: 7 / 80 and 9 / 80 lie below their halves as floats, 201 / 400 times 1000 does as a double."""
    words = {int(hashlib.md5(f"w{i}".encode()).hexdigest()[:8], 16) % 64: f"w{i}" for i in range(200)}
    texts = [" ".join(w for w, n in zip(words.values(), counts) for _ in range(n)) for counts in ((79, 9, 7, 5, 2), (345, 201, 23, 6, 3))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {i: list(v) for i, v in con.execute(catalog.oracle_sql()["vec_embed"]).fetchall()}
    assert {0.113, 0.088} < set(want[0]) and 0.502 in want[1]
    assert {r.doc_id: r.embedding for r in catalog.queries()["vec_embed"](spark, str(tmp_path)).collect()} == want


def test_files(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/sub/a.md").write_text("# A\ntext1\n## B\ntext2\n### C\ntext3\n## D\ntext4")
    (tmp_path / "docs/b.txt").write_text("no")
    files = markdown(spark, f"{tmp_path}/docs")
    assert [r.source for r in files.collect()] == ["sub/a.md"]
    assert [r.path for r in sections(files).orderBy("section").collect()] == ["A", "A > B", "A > B > C", "A > D"]
    assert not is_seeded(spark, f"{tmp_path}/v")
    append(spark.range(2), f"{tmp_path}/v")
    assert is_seeded(spark, f"{tmp_path}/v")
    truncate(spark, f"{tmp_path}/v")
    assert not is_seeded(spark, f"{tmp_path}/v")


@pytest.mark.parametrize("text", ["", " ".join(f"word{i}" for i in range(500)), "".join(chr(0x4E00 + i) for i in range(2500)), "\n\n".join(f"para{i}" for i in range(700))])
def test_split_text(text):
    parts = split_text(text)
    assert all(0 < len(p) <= 1000 for p in parts)
    at = 0
    for p in parts:
        start = text.find(p, max(0, at - 100))
        assert 0 <= start <= at
        at = start + len(p)
    assert at == len(text)


def test_image_ids():
    tree = '{"type":"doc","content":[{"type":"p","content":[{"type":"image","attrs":{"data-public-id":"a"}}]},{"type":"image","attrs":{"data-public-id":"b"}},{"type":"image","attrs":{"data-public-id":" "}},{"type":"list","content":[{"type":"image","attrs":{"data-public-id":"a"}}]}]}'
    assert image_ids(tree) == ["a", "b"] and image_ids("not json") is None and image_ids('{"type":"x"}') is None and image_ids('{"type":"doc"}') == []


def test_patch_and_ids(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, note string")
    new = spark.createDataFrame([(1, None, "z")], "id long, name string, note string")
    assert sorted(map(tuple, patch(rows, new, "id").collect())) == [(1, "a", "z"), (2, "b", "y")]
    made = spark.range(3).select((F.col("id") * 5 + 1718029381000).alias("ms")).select("ms", uuid7(F.col("ms")).alias("u")).orderBy("ms").collect()
    assert [r.u for r in made] == sorted(r.u for r in made) and all(len(r.u) == 36 and r.u[14] == "7" for r in made)


def test_more_questions_than_a_block(spark):
    from tessera.operators.vectors import search

    vectors = [(i, [float((i * 7 + d * 3) % 11 - 5) for d in range(4)]) for i in range(40)]
    chunks = spark.createDataFrame(vectors, "id long, embedding array<float>")
    asked = spark.createDataFrame([*vectors[:20], (3, vectors[3][1])], "question_id long, vector array<float>")
    rows = lambda df: sorted((r.question_id, r.rank, r.id, r.score) for r in df.collect())
    whole = rows(search(chunks, asked))
    assert len(whole) == 80 and rows(search(chunks, asked.repartition(3))) == whole
    assert search(chunks, asked.limit(0)).count() == 0
