"""Queries by name, each with the SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; `sql` is its twin over the fixture views."""

    def add(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql, "timestamp")
        return f

    return add


def plain(name: str, sql: str) -> None:
    """A query that both engines read from one text."""
    query(name, sql)(lambda t: t.sql(sql))
