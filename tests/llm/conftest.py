from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, size long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta", "en", "b", 22, 7, 1),
        (2, "ALPHA beta gamma delta", "en", "b", 22, 7, 1),
        (2, "ALPHA beta gamma delta", "en", "b", 22, 7, 1),
        (3, None, "en", None, None, None, None),
        (4, "", "fr", "a", 0, 0, 0),
        (5, " \n\t ", None, "a", 4, 0, 0),
        (None, "word", "en", "c", 4, 0, 0),
        (7, "All rights reserved. One two three four five six.\n" * 400, "en", "c", 0, 0, 0),
        (8, "É é alpha " + "x" * 5000, "fr", "a", 0, 0, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
