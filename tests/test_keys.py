from types import SimpleNamespace
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callsheet import session
from callsheet.operators import dense_ids, fill_defaults, keys
from callsheet.session import clear_workspace, materialise, own_workspace, shared_folder, workspace


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (-F.col("id")).alias("rank"))
    numbered = dense_ids(df.repartition(7), ["rank"], into="n").collect()
    assert {r.n: r.rank for r in numbered} == {i: i - 999 for i in range(1000)}


def test_dense_ids_split_a_hot_value(spark, monkeypatch):
    """Half of the rows share the leading value; the key behind it spreads them."""
    written = []

    def keep(df, label):
        written.append(materialise(df, label))
        return written[-1]

    monkeypatch.setattr(keys, "materialise", keep)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"),
        F.col("id").alias("k"),
    )
    try:
        numbered = dense_ids(df, ["name", "k"], into="n", start=5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ids = numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert ids == (5, 20_004, 20_000)
    hot = numbered.where(F.col("name") == "hot")
    steps = hot.agg(F.count_distinct(F.col("n") - F.col("k") / 2)).first()
    assert steps == (1,)
    assert written[0].where(F.col("name") == "hot").select("_range").distinct().count() > 1


def test_dense_ids_of_nothing(spark):
    assert dense_ids(spark.range(0).toDF("k"), ["k"]).count() == 0


def test_defaults_fill_missing_columns_only(spark):
    schema = StructType.fromDDL("id INT, suns INT, moons INT, note STRING")
    df = spark.createDataFrame([(1, None), (2, 3)], "id int, suns int")
    filled = fill_defaults(df, schema, {"suns": 1, "moons": 1})
    assert filled.schema.simpleString() == schema.simpleString()
    assert {tuple(r) for r in filled.collect()} == {(1, None, 1, None), (2, 3, 1, None)}


def test_materialise_reads_the_cluster_setting(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    kept = materialise(spark.range(3).toDF("k"), "probe")
    assert all(folder in path for path in kept.inputFiles())
    assert kept.count() == 3


def _session(master):
    found = MagicMock()
    found.conf.get.side_effect = lambda key, default=None: default
    found.sparkContext = SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, applicationId=master
    )
    return found


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_session("spark://host:7077"))
    folder = shared_folder(_session("local[2]"))
    assert folder and shared_folder(_session("local[2]")) == folder


def test_columns_without_a_place_are_an_error(spark):
    df = spark.createDataFrame([(1, 5)], "id int, sunz int")
    with pytest.raises(ValueError, match="sunz"):
        fill_defaults(df, StructType.fromDDL("id INT, suns INT"), {"suns": 1})


def test_a_range_that_is_too_long_is_an_error(spark, monkeypatch):
    """The mark of a row that no longer shows its range."""
    monkeypatch.setattr(keys.F, "monotonically_increasing_id", lambda: F.lit(1 << 40))
    with pytest.raises(Exception, match="more than 2"):
        dense_ids(spark.range(3).toDF("k"), ["k"]).collect()


def test_the_workspace_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    with own_workspace(spark) as folder:
        assert folder == workspace(spark) and folder.startswith(str(tmp_path))
        assert materialise(spark.range(3), "probe").count() == 3
        assert any(tmp_path.iterdir())
    assert not any(p for p in tmp_path.iterdir() if not p.name.startswith("."))
    clear_workspace(spark)  # nothing there is no error
