"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsheet.session import materialise

#: Words of the contracts: runs of anything but blank and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_prefixes(
    df: DataFrame, order_by: Sequence[str | Column], weight: str, label: str
) -> DataFrame:
    """Add ``row`` (place from 0), ``before`` (weight of all rows before) and
    ``total`` (weight of all rows), in the order of ``order_by``.

    The rows are sorted by ranges and written once; each range's count and
    weight are summed, and only those totals (a row per range, so at most one
    per shuffle partition) are accumulated in one task and broadcast. Rows with
    equal sort values may come in any order; it is fixed when they are written.
    """
    placed = materialise(
        df.orderBy(*order_by, F.monotonically_increasing_id()).select(
            "*",
            F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().alias("_place"),
        ),
        label,
    )
    ranges = placed.groupBy("_range").agg(
        F.count("*").alias("_rows"), F.sum(weight).alias("_weight")
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    starts = ranges.select(
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row0"),
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_weight0"),
        F.sum("_weight").over(every).alias("total"),
    )
    inside = Window.partitionBy("_range").orderBy("_place")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select(
        "*",
        (F.row_number().over(inside) - 1).cast("long").alias("_inner_row"),
        (F.sum(weight).over(upto) - F.col(weight)).alias("_inner_weight"),
    )
    return running.join(F.broadcast(starts), "_range").select(
        *df.columns,
        (F.col("_row0") + F.col("_inner_row")).alias("row"),
        (F.col("_weight0") + F.col("_inner_weight")).alias("before"),
        "total",
    )


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}  # executors fetch the file later


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would, unless
    they find it on their own path; once per application."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent.parent
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) in paths or context.applicationId in _SHIPPED:
        return
    folder = _SHIPPED[context.applicationId] = tempfile.TemporaryDirectory()
    name = os.path.join(folder.name, "callsheet-package.zip")
    with zipfile.ZipFile(name, "w") as package:
        for file in sorted((root / "callsheet").rglob("*.py")):
            package.write(file, file.relative_to(root))
    context.addPyFile(name)
