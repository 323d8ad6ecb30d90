"""A Merkle manifest of a table, with nodes labelled by the leaves they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import ordered_prefixes
from callsheet.session import materialise

#: Nodes that become one node of the next level.
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of a row: each value as its byte count, a colon and itself, or ``-``."""
    written = [v.cast("string") for v in values]
    return F.sha2(
        F.concat(
            *[
                F.when(v.isNull(), F.lit("-")).otherwise(
                    F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)
                )
                for v in written
            ]
        ),
        256,
    )


def _levels(leaves: DataFrame, label: str) -> list[DataFrame]:
    """The nodes of every level, from ``leaves`` (tree, lo, hi, digest, and ``n``,
    the tree's leaves). A node above carries the ranks ``lo`` to ``hi`` of the
    leaves below it and its children, 16 at most, each with its own interval.

    A tree ends where one node is left. Each level is written; it has a
    sixteenth of the rows of the one below.
    """
    levels, width = [leaves], 1
    most = leaves.agg(F.max("n")).first()[0] or 0
    while width < most:
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        above = (
            levels[-1]
            .where(F.col("n") > width)
            .groupBy("tree", F.floor(F.col("lo") / (width * FAN)).alias("bucket"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), children.alias("children"))
        )
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        levels.append(materialise(above.withColumn("digest", digest).drop("bucket"), label))
        width *= FAN
    return levels


def _with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path``: for each ancestor, from below, the digests of the
    siblings to the ``left`` and to the ``right`` of the node on the way; then the
    path of the tree's own last node, taken with all other columns from ``tops``.

    Level by level from above: a node and its parent meet in the bucket of their
    level, where the parent's interval contains the node's. Its siblings are the
    parent's children whose intervals lie before or after its own.
    """
    others = [c for c in tops.columns if c not in ("tree", "path")]
    placed = None
    for level in range(len(levels) - 1, -1, -1):
        width = FAN**level
        ends = F.col("n") <= width
        if level:
            ends = ends & (F.col("n") > width // FAN)
        found = levels[level].where(ends).join(tops, "tree")
        if placed is not None:
            bucket = lambda lo: F.floor(lo / (width * FAN))  # noqa: B023, E731
            below = levels[level].where(F.col("n") > width).alias("c")
            above = placed.select(
                "tree", "lo", "hi", "path", *others, F.col("children").alias("among")
            ).alias("p")
            met = below.join(
                above,
                (F.col("c.tree") == F.col("p.tree"))
                & (bucket(F.col("c.lo")) == bucket(F.col("p.lo")))
                & (F.col("p.lo") <= F.col("c.lo"))
                & (F.col("c.hi") <= F.col("p.hi")),
            )
            beside = lambda test: F.array_join(
                F.transform(F.filter("p.among", test), lambda s: s["digest"]), ""
            )
            own = F.struct(
                beside(lambda s: s["hi"] < F.col("c.lo")).alias("left"),
                beside(lambda s: s["lo"] > F.col("c.hi")).alias("right"),
            )
            joined = met.select(
                "c.*", *[F.col(f"p.{c}") for c in others], F.concat(F.array(own), "p.path").alias("path")
            )
            found = found.select(*joined.columns).union(joined)
        placed = found
    return placed


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(
        path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256)
    )


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    group: str = "source",
    key: str = "doc_id",
    presented: dict[str, Column] | None = None,
) -> DataFrame:
    """For every row of ``docs`` its ``leaf``, its place (``rank``) among the leaves
    of its ``group``, the group's ``subroot``, the ``root`` of all, the ``path``
    that proves it, and ``folded_root``, recomputed along that path from the row
    as ``presented``: with these columns in place of the recorded ones.

    A group's leaves ascend by key; 16 consecutive nodes become one, until one is
    left. The groups' last nodes, in the order of their groups, become the root in
    the same way.

    Rows are sorted by range, once; a node is labelled by the ranks of the leaves
    it covers, so parents and siblings are found by comparing intervals. All joins
    and groups have at most 16 rows to a key, but for that of the rows with their
    groups (a row each), which may be split where a group is hot. The driver sees
    the number of leaves of the largest group only.

    A null value is written ``-``; a null group is a group, before all others;
    null keys come before others; rows of equal group and key are in the order of
    their digests, and repeated rows are leaves of their own. A group of one row
    has the leaf as its subroot; a single group's subroot is the root. No rows give
    no rows. Columns not named are not read.
    """
    values = [F.col(f"`{c}`") for c in columns]
    shown = [(presented or {}).get(c, v) for c, v in zip(columns, values, strict=True)]
    hashed = materialise(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{group}`").alias("group"),
            record_hash(values).alias("digest"),
            record_hash(shown).alias("shown"),
        ),
        "leaf-digests",
    )
    rows = hashed.withColumn("one", F.lit(1))
    placed = materialise(
        ordered_prefixes(rows, ["group", "key", "digest"], "one", "sorted-leaves").select(
            "key", "group", "digest", "shown", "row"
        ),
        "leaves",
    )
    groups = materialise(
        placed.groupBy("group").agg(F.min("row").alias("tree"), F.count("*").alias("n")), "groups"
    )
    named = groups.withColumnRenamed("group", "_group")
    leaves = materialise(
        placed.join(named, F.col("group").eqNullSafe(F.col("_group")))
        .withColumn("lo", F.col("row") - F.col("tree"))
        .select("tree", "lo", F.col("lo").alias("hi"), "n", "digest", "shown", "key"),
        "group-leaves",
    )
    children = "array<struct<lo:bigint,hi:bigint,digest:string>>"
    lone = F.expr(f"CAST(array() AS {children})").alias("children")
    levels = _levels(leaves.withColumn("children", lone), "manifest-level")
    lasts = None
    for level, nodes in enumerate(levels):
        width = FAN**level
        ends = (F.col("n") <= width) & (F.col("n") > (width // FAN if level else 0))
        found = nodes.where(ends).select("tree", F.col("digest").alias("subroot"))
        lasts = found if lasts is None else lasts.union(found)

    # the groups in their order, as the leaves of one more tree
    one = lasts.withColumn("one", F.lit(1))
    ordered = materialise(ordered_prefixes(one, ["tree"], "one", "sorted-groups"), "subroots")
    top = ordered.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("row").alias("lo"),
        F.col("row").alias("hi"),
        F.col("total").cast("long").alias("n"),
        F.col("subroot").alias("digest"),
        F.col("tree").alias("of"),
        lone,
    )
    above = _levels(top, "manifest-top")
    root = above[-1].select("tree", F.col("digest").alias("root"), F.expr(
        "CAST(array() AS array<struct<left:string,right:string>>)"
    ).alias("path"))
    tops = materialise(
        _with_paths(above, root).select(
            F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "path"
        ),
        "manifest-tops",
    )
    return _with_paths(levels, tops).select(
        F.col("key").alias(key),
        F.col("digest").alias("leaf"),
        F.col("lo").alias("rank"),
        "subroot",
        "root",
        "path",
        folded(F.col("shown"), F.col("path")).alias("folded_root"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """The rows of the query: the documents as recorded, and every fifth or so
    presented with its capitals lowered."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(altered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proved = manifest(docs.select(*columns), columns, presented={"text": text})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
