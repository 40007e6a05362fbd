"""Reading and writing the community's files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path below the folder that the cluster shares (spark.checkpoint.dir), or in local mode below a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-tessera-')}"
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """source (path below the folder) and text of all files that fit the pattern, however deep."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    name = F.col("_metadata.file_path")
    return files.select(F.regexp_replace(name, r"^\w+:/*|^/*", "/").alias("path"), F.col("value").alias("text")).select(F.regexp_extract("path", f"{folder.rstrip('/').split('/')[-1]}/(.*)$", 1).alias("source"), "text")


def append(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def truncate(spark: SparkSession, folder: str) -> None:
    """Leaves an empty table with the same columns."""
    schema = spark.read.parquet(folder).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)


def is_seeded(spark: SparkSession, folder: str) -> bool:
    try:
        return not spark.read.parquet(folder).isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
