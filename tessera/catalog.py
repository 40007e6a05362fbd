"""All queries of the package by name, with their SQL twins."""

from __future__ import annotations

import importlib

from tessera.registry import ORACLE, QUERIES

MODULES = tuple(f"tessera.operators.{m}" for m in ("forum", "people", "play", "presence", "retrieval", "chunks", "rooms", "feeds", "commands", "commits", "titles", "trees"))


def _load() -> None:
    for name in MODULES:
        importlib.import_module(name)


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE
