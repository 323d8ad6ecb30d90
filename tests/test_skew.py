"""One key holds a third of the rows: joins split it, folds shrink it first."""

import pytest
from pyspark.sql import functions as F

from callsheet.operators import coverage, delete_rows, dense_ids, orphans, uncovered
from callsheet.plans import extreme_share, flag_wins, pair_totals
from callsheet.schemas import SET_NULL, ForeignKey
from callsheet.sources import to_turns

ROWS = 60_000
CLUSTER = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def large(spark):
    """Plan as for large tables: no broadcasts, and small pieces count as large."""
    before = {key: spark.conf.get(key, None) for key in CLUSTER}
    for key, value in CLUSTER.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture()
def fact(spark):
    """Every third row refers to key 7, the others to 0..999 in turn."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
    return spark.range(0, ROWS, 1, 8).select("id", hot.cast("int").alias("ref"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_orphans_split_the_hot_key(spark, large, fact):
    parents = spark.range(500).select(F.col("id").cast("int").alias("key"))
    lost = orphans(fact, "ref", parents, "key")
    assert "skew=true" in final_plan(lost)
    assert lost.count() == sum(1 for i in range(ROWS) if i % 3 and i % 1000 >= 500)


def test_set_null_splits_the_hot_key(spark, large, fact):
    parents = spark.range(1000).select(F.col("id").cast("int").alias("key"))
    link = ForeignKey("fact", "ref", "parent", "key", SET_NULL)
    after = delete_rows({"parent": parents, "fact": fact}, [link], "parent", F.col("key") == 7)
    assert "skew=true" in final_plan(after["fact"])
    left = after["fact"].agg(F.count("*"), F.count("ref")).first()
    kept = sum(1 for i in range(ROWS) if i % 3 and i % 1000 != 7)
    assert left == (ROWS, kept)


def test_ingest_splits_the_hot_speaker(spark, large, fact):
    names = spark.range(1000).select(
        F.concat(F.lit("S"), "id").alias("alias"), F.col("id").cast("int").alias("entity_id")
    )
    lines = fact.select(
        "id",
        F.lit(1).alias("source_part"),
        F.concat(F.lit("s"), "ref").alias("speaker"),
        F.lit(None).cast("string").alias("addressee"),
        F.lit("a b").alias("text"),
    )
    turns = to_turns(lines, names)
    assert "skew=true" in final_plan(turns)
    assert turns.agg(F.sum("word_count")).first()[0] == 2 * ROWS


def test_coverage_with_a_hot_key(spark, large, fact):
    people = spark.range(1100).select(F.col("id").cast("int").alias("key"))
    assert coverage(people, "key", fact, "ref").first() == (ROWS, True)
    missing = uncovered(people, "key", fact, "ref")
    assert {r.key for r in missing.collect()} == set(range(1000, 1100))


def test_reports_with_a_hot_pair(spark, large, fact):
    turns = fact.select(
        "id",
        F.col("ref").alias("from_id"),
        (F.col("ref") % 10).alias("to_id"),
        (F.col("id") % 50 + 1).alias("word_count"),
        F.concat(F.lit("line "), "id").alias("text"),
    )
    pairs, best = {}, {}
    for i in range(ROWS):
        ref = 7 if i % 3 == 0 else i % 1000
        pair = max(ref, ref % 10), min(ref, ref % 10)
        pairs[pair] = pairs.get(pair, 0) + i % 50 + 1
        best[pair] = min(best.get(pair, (0, 0)), (-(i % 50 + 1), i))
    found = pair_totals(turns).collect()
    assert {(r.hi_id, r.lo_id): r.words for r in found} == pairs
    assert {(r.hi_id, r.lo_id): r.example for r in found} == {
        pair: f"line {i}" for pair, (_, i) in best.items()
    }
    flags = spark.range(1000).select("id", (F.col("id") < 10).alias("flag"))
    contests = turns.select(
        F.col("from_id").alias("first_id"),
        F.col("to_id").alias("second_id"),
        F.lit(True).alias("outcome"),
    )
    wins = sum(1 for i in range(ROWS) if i % 3 and i % 1000 >= 10)
    assert [tuple(r) for r in flag_wins(contests, flags, "flag").collect()] == [(False, wins)]


def test_a_hot_part_is_ranked_and_numbered(spark, large, fact):
    """The part is the hot key: a third of the rollup rows are in it."""
    rollup = fact.select(
        F.col("ref").alias("part_id"), F.col("id").alias("entity_id"), F.lit(1).alias("words")
    )
    parts = spark.range(1000).select(
        F.col("id").cast("int").alias("part_id"),
        F.lit("p").alias("name"),
        F.lit(10).alias("words_total"),
        F.lit(100).alias("money"),
    )
    people = spark.range(ROWS).select("id", F.lit("e").alias("name"))
    winners = {r.part_id: r.entity_id for r in extreme_share(rollup, parts, people).collect()}
    expected = {}
    for i in range(ROWS):
        expected.setdefault(7 if i % 3 == 0 else i % 1000, i)
    assert winners == expected
    numbered = dense_ids(rollup, ["part_id", "entity_id"], into="n")
    assert numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (
        0,
        ROWS - 1,
        ROWS,
    )
