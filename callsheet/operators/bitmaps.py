"""Orphans of integer keys by bitmaps: neither table is shuffled row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from callsheet.session import materialise

#: Values of a bitmap, and its bytes, as Spark's bitmap functions lay them out.
VALUES, BYTES = 32_768, 4_096


def _bitmaps(df: DataFrame, column: str, into: str) -> DataFrame:
    """``bucket`` and the bitmap of the values in it. A task sends a bitmap for each
    bucket it meets, whatever the number of its rows."""
    value = F.col(column).cast("long")
    positions = df.where(value.isNotNull()).select(
        F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("position")
    )
    return positions.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias(into))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``child.column`` that are no ``parent.key``.

    The values of both tables become bitmaps of 32,768 values each, in every task
    before the shuffle; so what is shuffled is at most 4 KB per task and bucket, and a
    value that comes a billion times is one bit. Buckets are then compared one by
    one, byte by byte, where their bitmaps differ. Meant for integer keys from a counter; of keys scattered over
    the whole range each would need a bitmap, so use :func:`orphans` for these. NULL
    references are legal. Columns of other types are an error.
    """
    for df, name in ((child, column), (parent, key)):
        if not isinstance(df.schema[name].dataType, IntegralType):
            raise ValueError(f"{name} is no integer column")
    ours, theirs = _bitmaps(child, column, "ours"), _bitmaps(parent, key, "theirs")
    met = ours.join(theirs, "bucket", "left")
    none = F.unhex(F.lit("00" * BYTES))
    lost = lambda at: _byte(F.col("ours"), at).bitwiseAND(
        F.bitwise_not(_byte(F.coalesce("theirs", none), at))
    )
    every = F.sequence(F.lit(0), F.lit(BYTES - 1))
    found = F.transform(every, lambda at: F.struct(at.alias("at"), lost(at).alias("lost")))
    # unpacked within the row: the bitmaps are not copied for each byte
    left = met.where(F.col("theirs").isNull() | (F.col("ours") != F.col("theirs"))).select(
        "bucket", F.inline(F.filter(found, lambda x: x["lost"] != 0))
    )
    bit = left.select("bucket", "at", "lost", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    position = F.col("at") * 8 + F.col("bit")
    value = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * VALUES + position + 1).otherwise(
        F.col("bucket") * VALUES - position
    )
    return bit.where("(lost & shiftleft(1, bit)) <> 0").select(
        value.cast(child.schema[column].dataType).alias(column)
    )


def orphans_by_bitmap(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """As :func:`orphans`: the child rows whose reference meets no parent.

    The lost keys are written, so their number is known, and few of them go to the
    child's rows instead of the rows to them.
    """
    lost = materialise(orphan_keys(child, column, parent, key).toDF("_lost"), "lost-keys")
    return child.join(lost, F.col(column) == F.col("_lost"), "left_semi")
