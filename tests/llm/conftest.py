"""Tables with every awkward row: nulls, empty and very long texts, ties, repeated rows,
and extra columns whose names the operators use themselves."""

import random

import pytest
from odd_tables import DOCUMENTS, EXTRA, words


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    base, long = words(rng, 120), words(rng, 9000)
    shared = words(rng, 60)
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, base + " tail", "en"),
        (4, words(rng, 40) + " " + shared + " " + words(rng, 30), "de"),
        (5, words(rng, 50) + " " + shared, "de"),
        (6, None, None),
        (7, "", "en"),
        (8, "", None),
        (9, long, "fr"),
        (10, long[:-40] + " other end", "fr"),
        (11, "a", "en"),
        (12, "1 2 3 !", "en"),
        (13, "x" * 700, "en"),
        (14, "Ünïcödé straße 日本 \U0001f600 " * 12, "de"),
        (15, "  leading, and   inner\tspaces\n\n", "en"),
        (None, "text without an id", "en"),
        (None, None, None),
        (16, "repeated row", "en"),
        (16, "repeated row", "en"),
        (17, "b a d", "en"),
    ]
    return [(i, t, lang, None, None, *EXTRA) for i, t, lang in rows]


@pytest.fixture
def table_of(spark, tmp_path):
    """Write rows as a Parquet table (operators read stored tables) and read it back."""

    def make(rows, schema=DOCUMENTS, name="documents"):
        path = str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}.parquet")
        spark.createDataFrame(rows, schema).coalesce(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def odd(table_of, odd_rows):
    return table_of(odd_rows)


@pytest.fixture
def nothing(table_of):
    return table_of([])
