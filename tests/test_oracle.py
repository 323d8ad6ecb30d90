"""Every registered query against DuckDB on the given tables."""

import math
import re
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')"
        )
    yield connection
    connection.close()


def _plain(value):
    if isinstance(value, Decimal):
        raise AssertionError("registered results use long, double and string only")
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(v is None, str(type(v)), v) for v in row])


def test_every_query_has_an_oracle():
    """The numbered queries and the pipeline have their tests in tests/llm."""
    numbered = {name for name in queries() if re.match(r"op\d+_|pipeline$", name)}
    assert set(queries()) - numbered == set(oracle_sql()) - numbered


def test_entry_runs(spark):
    assert entry(spark).count() == 4


DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    found = queries()[name](spark, SF_DIR)
    wanted = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    types = {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in found.schema.fields}
    assert types == {c[0]: str(c[1]) for c in wanted.description}
    rows = _sorted(found.columns, found.collect())
    assert rows == _sorted(columns, wanted.fetchall())
    assert rows or name == "nth_ranked_empty"
