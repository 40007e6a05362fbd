"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one
reads it. Toxic documents go, then exact copies, then all but one of each group of near copies (five
words, similarity 0.8); the mix repeats or leaves out documents until the sources' weights are met;
packing turns what is left into sequences. SQL can't express the field, the hash bands, the schedule
and the genetic algorithm: tests hold the first stage against the scores, both kinds of copies against
brute force, and the mix and the packing against their laws (draws, ids, lengths).

Edge cases, in any stage: null and empty texts are documents like others until the mix, which takes
none of their words; rows that repeat doc_id and text become one; rows that share a doc_id alone are
apart; a null doc_id, lang or source is a value like others; very long texts are read whole; an
empty table gives no rows; further columns stay, whatever their names, until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents, release, save, saved
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.minhash import near_dedup
from tessera.llm.mixing import mix_documents
from tessera.llm.packing import pack
from tessera.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, documents(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).drop("uid")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), set(saved())
    for name, stage in STAGES:
        docs, held = save(stage(spark, docs, sf_dir), name), saved()
        release(spark, [path for path in held[:-1] if path not in before])  # what the stage and the one before wrote
    return docs
