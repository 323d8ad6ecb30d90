"""Surrogate ids and column defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callsheet.session import materialise


#: What the lower bits of a row's mark can tell apart within its range.
PLACES = (1 << 33) - 1


def dense_ids(
    df: DataFrame, order_by: Sequence[str | Column], into: str = "id", start: int = 0
) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order_by``.

    ``order_by`` must tell the rows apart (end it with a key): the order is then
    total, and range partitioning can split any run of equal leading values.
    Ids a caller already has need no operator.

    The sorted ranges are written once with each row's range and place in it;
    the ids are those places plus the sizes of the ranges before. Only the list
    of ranges (at most one per shuffle partition) is numbered in one task and
    broadcast, never the rows.
    """
    mark = F.monotonically_increasing_id()
    placed = materialise(
        df.orderBy(*order_by).select(
            "*",
            F.spark_partition_id().alias("_range"),
            F.when(F.shiftright(mark, 33) == F.spark_partition_id(), mark.bitwiseAND(F.lit(PLACES)))
            .otherwise(F.raise_error(F.lit("a range has more than 2**33 rows; use more ranges")))
            .alias("_place"),
        ),
        "dense-ids",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    numbered = placed.join(F.broadcast(offsets), "_range")
    return numbered.select(
        *df.columns, (F.col("_offset") + F.col("_place") + F.lit(start)).alias(into)
    )


def fill_defaults(df: DataFrame, schema: StructType, defaults: Mapping[str, Any]) -> DataFrame:
    """Lay ``df`` out as ``schema``; a column it lacks takes its default or NULL.

    A NULL that is present stays NULL. A column that the schema does not name is
    an error, so that no value is lost.
    """
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"the schema does not name {', '.join(unknown)}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )
