"""Orphans by bitmaps against the anti-join."""

import random

import pytest
from tables import rows

from callsheet.operators import orphan_keys, orphans, orphans_by_bitmap


@pytest.mark.parametrize("kind", ["TINYINT", "INT", "BIGINT"])
@pytest.mark.parametrize("seed", range(3))
def test_equals_the_anti_join(spark, kind, seed):
    rnd = random.Random(seed)
    edges = [0, 1, -1, 7, 8, 100, -100, 127, -128]
    if kind != "TINYINT":
        edges += [32767, 32768, 32769, 65536, 65537, -32767, -32768, -32769, 10**9]
    if kind == "BIGINT":
        edges += [2**62, -(2**62), 10**12]
    child = [(rnd.choice([None, *edges]), i) for i in range(60)]
    parent = [(v,) for v in edges if rnd.random() < 0.5] + [(None,)]
    child = spark.createDataFrame(child, f"ref {kind}, i INT")
    parent = spark.createDataFrame(parent * 2, f"id {kind}")
    wanted = orphans(child, "ref", parent, "id")
    assert rows(orphans_by_bitmap(child, "ref", parent, "id")) == rows(wanted)
    found = orphan_keys(child, "ref", parent, "id")
    assert rows(found) == rows(wanted.select("ref").distinct()) and found.dtypes == wanted.select("ref").dtypes


def test_empty_sides_and_other_types(spark):
    some, none = spark.range(3).toDF("id"), spark.range(0).toDF("id")
    assert rows(orphan_keys(some, "id", none, "id")) == [(0,), (1,), (2,)]
    assert orphan_keys(none, "id", some, "id").count() == orphan_keys(some, "id", some, "id").count() == 0
    with pytest.raises(ValueError):
        orphan_keys(some.selectExpr("CAST(id AS STRING) AS id"), "id", some, "id")
