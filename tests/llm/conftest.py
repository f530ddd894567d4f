from __future__ import annotations

import pytest
from llm_texts import edited, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, doc string, lines string, kept string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "\n".join(words(80, 900 + k) for k in range(60))
    base = words(200, 1)
    rows = [
        (0, words(40, 2), "a", "s0"), (1, "", "a", "s0"), (2, None, "b", "s1"), (3, long, "b", None), (4, base, None, "s1"),
        (5, edited(base, 90, 3), "a", "s1"), (6, base, "a", "s0"), (6, base, "a", "s0"), (7, " \n\t ", "b", "s0"), (None, words(30, 4), "b", "s2"),
        (None, None, None, None), (8, "one", "a", "s0"), (9, words(60, 5) + "\n" + words(60, 6), "b", "s2"), (10, words(25, 7) + "\n" + words(60, 6), "b", "s2"),
        (9007199254740993, "Licensed under the MIT License. " + words(30, 8), "a", "s0"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 3, "d", "l", "k") for i, t, g, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
