from __future__ import annotations

import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "Same text  here", "en", "a", "x", 1),
        (2, "Same text here", "en", "a", None, 2),
        (2, "Same text here", "en", "a", None, 2),
        (3, None, None, None, "y", None),
        (4, "", "en", "b", "y", 4),
        (None, "Same\ttext here", "fr", "a", "z", 5),
        (5, "word " * 40_000, "en", "b", "z", 6),
        (6, " \n ", "de", None, "z", 7),
        (7, "Ünïcode wörds — zum Beispiel ß 日本語", "de", "c", "z", 8),
        (-8, "negative id", "en", "c", "z", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, row long")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept string, row long")
