"""Connected components of links between nodes, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.session import materialise


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (the least node it is linked with, over any number of
    links) for every node in ``links``, which has the columns ``a`` and ``b``.

    Large and small stars in turn: first every node links its larger neighbours
    to the least of its neighbourhood, then its smaller ones and itself. The
    links become stars around the roots after a number of rounds that grows
    with the logarithm of the longest path. Each round is written, so lineage
    stays short; only its count and checksum come to the driver. Hubs are joined,
    never collected. No links give no rows.
    """
    apart = links.where("a <> b")
    now = materialise(
        apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    print_of = lambda df: df.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    ).first()
    seen = print_of(now)
    while seen["n"]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("a"), F.col("m").alias("b")
        )
        large = materialise(large.where("a <> b").distinct(), label)
        if print_of(large) == seen:  # stars already
            break
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(low, "a").where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        now = materialise(turned.union(low.select("a", "m")).distinct(), label)
        seen = print_of(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
