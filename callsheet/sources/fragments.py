"""Names that hold fragments, by an index of their pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.session import materialise

#: Characters of a piece; a shorter fragment is a piece itself.
PIECE = 3


def _pieces(name: Column, size: int) -> Column:
    """The distinct pieces of a name that have ``size`` characters."""
    none = F.expr("CAST(array() AS array<string>)")
    if size == 0:
        return F.array(F.lit(""))
    places = F.sequence(F.lit(1), F.length(name) - size + 1)
    found = F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(size))))
    return F.when(F.length(name) >= size, found).otherwise(none)


def names_with_fragments(names: DataFrame, fragments: DataFrame) -> DataFrame:
    """``fragment`` and ``name`` for every fragment and every distinct name that holds
    it anywhere; both tables have one column.

    Each name is indexed under its pieces of three characters, and each fragment is
    looked up under that of its pieces which the fewest names have; then the names
    found are compared in full. So any number of fragments takes equal joins, and no
    fragment meets names that lack a piece of it. Shorter fragments are looked up
    under themselves, the empty one is in every name. Case counts; NULLs match
    nothing.
    """
    name, fragment = F.col(f"`{names.columns[0]}`"), F.col(f"`{fragments.columns[0]}`")
    asked = fragments.select(fragment.alias("fragment")).where("fragment IS NOT NULL").distinct()
    asked = materialise(asked, "fragments")
    known = names.select(name.alias("name")).where("name IS NOT NULL").distinct()
    length = F.least(F.length("fragment"), F.lit(PIECE))
    sizes = sorted(r[0] for r in asked.select(length).distinct().collect())
    if not sizes:
        return asked.select("fragment", F.col("fragment").alias("name"))
    index = known.select("name", F.explode(F.concat(*[_pieces(F.col("name"), n) for n in sizes])).alias("piece"))
    index = materialise(index, "name-pieces")
    own = F.coalesce(*[F.when(length == n, _pieces(F.col("fragment"), n)) for n in sizes])
    pieces = asked.select("fragment", F.explode(own).alias("piece"))
    common = index.groupBy("piece").agg(F.count("*").alias("names"))
    # a piece that no name has: then no name has the fragment
    rarest = (
        pieces.join(common, "piece", "left")
        .groupBy("fragment")
        .agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece")).alias("best"))
        .where("best.names > 0")
    )
    met = rarest.select("fragment", F.col("best.piece").alias("piece")).join(index, "piece")
    return met.where(F.contains("name", "fragment")).select("fragment", "name")
