"""Exact top-k against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.llm import topk
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def brute(rows, is_query, k):
    vectors = []
    for key, values in rows:
        if key is None or values is None or any(x is None or not math.isfinite(x) for x in values):
            continue
        vectors.append((key, tuple(math.floor(256 * float(np.float32(x))) for x in values)))
    found = []
    for at, (q, a) in enumerate(vectors):
        if is_query(q):
            scored = sorted(
                (-sum(x * y for x, y in zip(a, b)), key)
                for other, (key, b) in enumerate(vectors)
                if other != at
            )
            found += [(q, n + 1, key, -s) for n, (s, key) in enumerate(scored[:k])]
    return sorted(found)


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    found = queries()["op1_threshold_top_k"](spark, SMALL)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda q: q % 50 == 0, 5)


@pytest.mark.parametrize("rows_in_block, queries_in_block", [(16384, 512), (7, 2)])
def test_ties_and_odd_vectors(spark, monkeypatch, rows_in_block, queries_in_block):
    monkeypatch.setattr(topk, "ROWS", rows_in_block)
    monkeypatch.setattr(topk, "QUERIES", queries_in_block)
    rnd = random.Random(1)
    # few values, so that many scores are equal
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25]) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf")])]
    rows += [(104, []), (105, [0.5]), (None, [1.0]), (10, [9.0] * 4), rows[20], (106, [0.0] * 4)]
    rows += [(107, [1e6, -1e6, 1e6, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    found = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=3)
    wanted = brute(
        [(k, v if v is None else v + [0.0] * (4 - len(v))) for k, v in rows],
        lambda q: q % 10 == 0,
        3,
    )
    assert sorted(map(tuple, found.collect())) == wanted


def test_empty_and_fewer_rows_than_k(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)
    assert sorted(map(tuple, topk.top_k(two, F.lit(True)).collect())) == [
        (1, 1, 2, 256 * 512),
        (2, 1, 1, 256 * 512),
    ]


def test_rows_of_one_id_are_all_ranked(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (50, [3.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=3)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda q: q % 50 == 0, 3)


def test_stops_before_the_end():
    rows = np.zeros((1000, 2))
    rows[:, 0] = np.arange(1000)
    order = np.argsort(rows, axis=0, kind="stable")
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    at, best = topk.threshold_search(
        np.arange(1000),
        rows.view(Counted),
        np.array([1.0, 0.0]),
        -1,
        5,
        (order, np.take_along_axis(rows, order, 0)),
    )
    assert at.tolist() == [999, 998, 997, 996, 995] and sum(seen) < 200
