"""Rows that every operator must take: nulls, empty and very long texts, ties and repeated rows."""

import pytest

ODD = [
    (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "no key"), (3, ""), (4, " \t\n "),
    (5, "word " * 30_000), (6, "x" * 70_000), (7, "É'll 12²  日本語\n\n👍🏽 it's\x00 \x1c"), (8, "a b c d e f g"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows and extra columns whose names clash with those of results."""
    rows = [(i, t, "zz", n, "x") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n_lines int, shard string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
