"""Small tables with odd rows, and the test documents."""

from __future__ import annotations

import os

import pandas as pd
import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 97} goes, on{i % 13}." for i in range(20_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. And so it goes on and on.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog. And so it goes on and on.", "en", None, 70),
    (2, "The quick brown fox jumps over the lazy dog. And so it goes on and on.", "en", None, 70),
    (3, None, "en", "a", None),
    (4, "", None, "a", 0),
    (5, " \t\n ", "en", "a", 4),
    (6, "one", "en", "a", 3),
    (7, "12345 !!! ???", "en", "a", 13),
    (None, "a row without an id, mail x@y.org now", "en", "a", 37),
    (None, None, None, None, None),
    (8, LONG, "en", "a", len(LONG)),
    (9, "ÀÉ ßü 日本語 \U0001f600 text", "de", "b", 18),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(spark, odd):
    """The same rows with more columns, named like those that operators make."""
    names = "id key h runs words lines text_hash fp root component_id start end part item blob findings portion".split()
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are absent")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs) -> pd.DataFrame:
    return docs.toPandas()


def lower(text: str | None) -> str:
    """A-Z lower-cased and nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
