"""Measures derived from the turn fact: words, rollups, updates and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions import word_count
from callsheet.session import materialise


class RejectedPairs(ValueError):
    """A strict load met pairs without a measure."""


def with_word_count(turns: DataFrame, text: str = "text", into: str = "word_count") -> DataFrame:
    """Set each turn's word count; the key is unique, so no join is needed."""
    return turns.withColumn(into, word_count(F.col(text)))


def entity_rollup(
    turns: DataFrame,
    entity: str = "from_id",
    part: str = "part_id",
    words: str = "word_count",
    into: str = "words",
) -> DataFrame:
    """Words per entity and part."""
    return turns.groupBy(entity, part).agg(F.sum(words).alias(into))


def update_from(
    dim: DataFrame, key: str, source: DataFrame, source_key: str, column: str, value: str
) -> DataFrame:
    """Overwrite ``dim.column`` by ``source.value`` where the keys meet.

    Rows without a match keep their old value; a matched NULL does overwrite.
    ``source`` must have one row per key, as an aggregate by that key has; a key
    that comes twice is an error, never a second row.
    """
    twice = F.raise_error(F.concat(F.lit("an update has several rows for "), "_update_key"))
    updates = (
        source.groupBy(F.col(source_key).alias("_update_key"))
        .agg(F.first(value).alias("_update_value"), F.count("*").alias("_rows"))
        .select(
            "_update_key",
            F.when((F.col("_rows") > 1) & F.col("_update_key").isNotNull(), twice)
            .otherwise(F.col("_update_value"))
            .alias("_update_value"),
            F.lit(True).alias("_matched"),
        )
    )
    new = F.when(F.col("_matched"), F.col("_update_value")).otherwise(F.col(column))
    return (
        dim.join(updates, F.col(key) == F.col("_update_key"), "left")
        .withColumn(column, new)
        .select(*dim.columns)
    )


def pair_rollup(
    turns: DataFrame,
    source: str = "from_id",
    target: str = "to_id",
    words: str = "word_count",
    into: str = "words",
) -> DataFrame:
    """Words per directed pair; the measure of a pair with a NULL end is NULL."""
    both = F.col(source).isNotNull() & F.col(target).isNotNull()
    return turns.groupBy(source, target).agg(F.when(both, F.sum(words)).alias(into))


def split_pairs(pairs: DataFrame, measure: str = "words") -> tuple[DataFrame, DataFrame]:
    """Pairs that a NOT NULL measure accepts, and the ones it rejects."""
    return pairs.where(F.col(measure).isNotNull()), pairs.where(F.col(measure).isNull())


def accept_pairs(pairs: DataFrame, measure: str = "words", mode: str = "strict") -> DataFrame:
    """Pairs to load: all or nothing (``strict``), or the good ones (``quarantine``).

    A strict load has to see all pairs before it lets one pass, so they are
    written first and not computed again for the load.
    """
    if mode == "quarantine":
        return split_pairs(pairs, measure)[0]
    if mode != "strict":
        raise ValueError(f"mode must be 'strict' or 'quarantine', not {mode!r}")
    pairs = materialise(pairs, "strict-pairs")
    rejected = split_pairs(pairs, measure)[1].count()
    if rejected:
        raise RejectedPairs(f"{rejected} pairs have no {measure}; nothing is loaded")
    return pairs
