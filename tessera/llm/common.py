"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch: long documents make larger batches too big for a Python worker.
ARROW_ROWS = 500
#: Written tables of this process, for release().
_saved: list[str] = []


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for this session; it holds on, because results are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    _saved.append(path)
    return spark.read.schema(df.schema).parquet(path)


def saved() -> list[str]:
    """The paths of the tables that save() has written and release() has not deleted."""
    return list(_saved)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written by save(). Only for callers whose results from them are already stored."""
    for path in paths:
        _saved.remove(path)
        p, fs = _hadoop_path(spark, path)
        fs.delete(p, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem = f"_{stem}"
    return stem


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Id and text of a row in one string, for finding rows again; copies of a text and rows without an id have many keys."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.xxhash64(F.col(text_col)).cast("string"))


def keep_keys(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose key is in the first column of `kept`, one row a key. Each row of `docs` is shuffled once."""
    name, other = free_name(docs, "row_key"), free_name(docs, "kept_key")
    kept = kept.select(F.col(kept.columns[0]).alias(other))
    keyed = docs.withColumn(name, key)
    return keyed.join(kept, keyed[name] == kept[other], "left_semi").dropDuplicates([name]).drop(name)
