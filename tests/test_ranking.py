"""The n-th row by counting, against a sort."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callsheet.operators import nth_row, ranking


@pytest.fixture()
def tight(monkeypatch):
    """Few rows count as many, so that all rounds are run."""
    monkeypatch.setattr(ranking, "FEW", 3)
    monkeypatch.setattr(ranking, "SPLITTERS", 4)
    monkeypatch.setattr(ranking, "SAMPLE", 20)


def ordered(rows, order):
    """NULLs last, whichever way a column goes."""
    for at, down in reversed(order):
        known = [r for r in rows if r[at] is not None]
        known.sort(key=lambda r: r[at], reverse=down)
        rows = known + [r for r in rows if r[at] is None]
    return rows


VALUES = {
    "INT": lambda rnd: rnd.randrange(-3, 4),
    "DOUBLE": lambda rnd: rnd.choice([-1.5, 0.0, 2.25, float("inf"), 1e300]),
    "STRING": lambda rnd: rnd.choice(["", "a", "aa", "Z", "é", "中"]),
    "DECIMAL(30,2)": lambda rnd: Decimal(rnd.randrange(10)) / 4 * 10**20,
}


@pytest.mark.parametrize("kind", sorted(VALUES))
@pytest.mark.parametrize("down", [True, False])
def test_equals_a_sort(spark, tight, kind, down):
    rnd = random.Random(f"{kind}{down}")
    rows = [(VALUES[kind](rnd) if rnd.random() < 0.9 else None, i) for i in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, f"score {kind}, id INT").repartition(4)
    order = [("score", down), ("id", False)]
    wanted = ordered([*rows], [(0, down), (1, False)])
    if kind == "STRING":  # by bytes, as Spark sorts
        wanted = ordered([(None if s is None else s.encode(), i) for s, i in rows], [(0, down), (1, False)])
        wanted = [(None if s is None else s.decode(), i) for s, i in wanted]
    for n in (1, 2, 7, 30, 59, 60):
        assert [tuple(r) for r in nth_row(df, order, n).collect()] == [wanted[n - 1]]
    for n in (0, -1, 61, 10**12, None):
        assert nth_row(df, order, n).collect() == []


def test_many_equal_rows_end_the_search(spark, tight):
    df = spark.range(500).select(F.when(F.col("id") < 495, 1).otherwise(F.col("id")).alias("score"))
    order = [("score", False)]
    assert [nth_row(df, order, n).first()[0] for n in (1, 250, 495, 496, 500)] == [1, 1, 1, 495, 499]
    assert nth_row(df, order, 501).isEmpty()
    assert nth_row(df.limit(0), order, 1).isEmpty()
    nulls = df.select(F.lit(None).cast("int").alias("score"))
    assert nth_row(nulls, order, 400).first()[0] is None


def test_a_range_is_found_by_few_comparisons(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(12)]), rnd.choice([None, *"abcdefgh"])) for _ in range(400)]
    df, order = spark.createDataFrame(rows, "a INT, b STRING"), [("a", True), ("b", False)]
    places = ordered(sorted(set(rows), key=str), [(1, False)])
    places = ordered(places, [(0, True)])
    for splitters in ([], places[40:41], places[:2], places[-5:], places[::2][:63]):
        place = ranking._range_of(df, order, splitters)
        assert str(place).count(">") < 20
        found = {}
        for a, b, at in df.select("a", "b", place).collect():
            before = sum(places.index(s) < places.index((a, b)) for s in splitters)
            assert at == 2 * before + ((a, b) in splitters)
            found.setdefault(at, []).append((a, b))
        for at in (0, 1, 2, 37, 2 * len(splitters)):
            if at <= 2 * len(splitters):
                inside = df.where(ranking._in_range(df, order, splitters, at)).collect()
                assert sorted(map(str, map(tuple, inside))) == sorted(map(str, found.get(at, [])))
