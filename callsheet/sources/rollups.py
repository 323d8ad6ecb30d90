"""Stored rollups that appended batches are folded into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from callsheet.session import materialise
from callsheet.sources.tables import (
    _filesystem,
    finish_replacing,
    read_table,
    replace_partitions,
)

#: The partition that holds the names of the batches.
LEDGER = -1


def rollup_states(
    turns: DataFrame, keys: Sequence[str], words: str = "word_count", turn: str | Sequence[str] | None = None
) -> DataFrame:
    """Per ``keys`` the mergeable state of the measures: ``words`` (sum), ``turns``
    (rows), and with ``turn`` the ``longest``, whose least value is the longest turn
    with the smallest id. States of disjoint rows give the state of all of them
    (:func:`merged_states`)."""
    measures = [F.sum(words).cast("long").alias("words"), F.count("*").alias("turns")]
    if turn is not None:
        length = F.col(words).cast("long")
        key = F.col(turn) if isinstance(turn, str) else F.struct(*turn)
        best = F.struct(length.isNull().alias("unknown"), (-length).alias("back"), key.alias("turn"))
        measures.append(F.min(best).alias("longest"))
    return turns.groupBy(*keys).agg(*measures)


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per ``keys`` from any number of them."""
    measures = [F.sum("words").alias("words"), F.sum("turns").alias("turns")]
    if "longest" in states.columns:
        measures.append(F.min("longest").alias("longest"))
    return states.groupBy(*keys).agg(*measures)


class StoredRollup:
    """A rollup by ``keys`` in the folder ``path``, kept up to date from batches.

    What is stored are states, dealt to ``buckets`` partitions by the hash of their
    keys. :meth:`fold` reads the rows of the new batch and the buckets that its keys
    fall into, and writes these anew; older rows are never read again, and other
    buckets keep their files. The names of the batches are a partition of the same
    table and are put in place with the states, so a batch counts once, also when a
    program died while folding it and folds it again. One fold at a time.

    Keys may be NULL; measures that are NULL count as turns, not as words.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        words: str = "word_count",
        turn: str | Sequence[str] | None = None,
        buckets: int = 16,
    ):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.words, self.turn, self.buckets = words, turn, buckets

    def fold(self, batch: DataFrame, name: str) -> list[str]:
        """Fold a batch in; return the folders written, none if it is in already."""
        finish_replacing(self.spark, self.path)
        delta = rollup_states(batch, self.keys, self.words, self.turn)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        delta = materialise(delta.withColumn("bucket", bucket), "rollup-delta")
        schema = StructType(
            [*delta.schema.fields, StructField("batch", StringType())]
        )
        states = delta.withColumn("batch", F.lit(None).cast("string"))
        ledger = self.spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in delta.schema.fields if f.name != "bucket"],
            F.lit(LEDGER).alias("bucket"),
            F.lit(name).alias("batch"),
        )
        if self._exists():
            stored = read_table(self.spark, self.path, schema)
            batches = stored.where(F.col("bucket") == LEDGER)
            if not batches.where(F.col("batch") == name).isEmpty():
                return []
            touched = [r["bucket"] for r in delta.select("bucket").distinct().collect()]
            states = states.unionByName(stored.where(F.col("bucket").isin(touched)))
            ledger = ledger.unionByName(batches)
        merged = merged_states(states, [*self.keys, "bucket"])
        merged = merged.withColumn("batch", F.lit(None).cast("string"))
        return replace_partitions(merged.unionByName(ledger), self.path, ["bucket"])

    def read(self) -> DataFrame:
        """The rollup: keys, ``words``, ``turns``, and the id of the ``longest`` turn."""
        stored = self.spark.read.parquet(self.path).where(F.col("bucket") != LEDGER)
        measures = ["words", "turns"]
        if self.turn is not None:
            measures.append(F.col("longest.turn").alias("longest"))
        return stored.select(*self.keys, *measures)

    def batches(self) -> DataFrame:
        """The names of the batches that are in."""
        schema = StructType([StructField("bucket", IntegerType()), StructField("batch", StringType())])
        if not self._exists():
            return self.spark.createDataFrame([], "batch STRING")
        return read_table(self.spark, self.path, schema).where(F.col("bucket") == LEDGER).select("batch")

    def _exists(self) -> bool:
        where, files = _filesystem(self.spark, self.path)
        return files.exists(where)
