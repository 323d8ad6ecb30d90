
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from callsheet.llm.common import ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents():
    """Key and text of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of key and text as a DataFrame, with columns whose names clash."""

    def make(rows):
        base = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
        return base.selectExpr("doc_id", "text", "1 AS row", "'x' AS hash", "2 AS _text", "3 AS size")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null keys and texts, empty and very long texts, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None),
        (2, ""),
        (None, "a null key and some words"),
        (None, None),
        (3, " \n\t "),
        (4, "same words here"),
        (4, "same words here"),
        (4, "other words here"),
        (5, long),
        (6, "é ß 日本 🎉 <|endoftext|> x y \x1c z"),
        (-7, "a " * 300),
    ]
