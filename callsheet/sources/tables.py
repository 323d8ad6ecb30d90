"""Typed Parquet tables: scan, literal rows, append and replace."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callsheet.operators.derive import update_from
from callsheet.operators.keys import dense_ids
from callsheet.session import materialise


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan Parquet with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def literal_rows(
    spark: SparkSession, rows: Iterable[Sequence[Any]], schema: StructType
) -> DataFrame:
    """A table from a few rows written in the program.

    They go over as an Arrow table, which Catalyst holds as a local relation of
    known size: joins with it are broadcast, and need no Python worker.
    """
    rows = list(rows)
    columns = {name: pa.array([row[i] for row in rows]) for i, name in enumerate(schema.names)}
    return spark.createDataFrame(pa.table(columns), schema)


def _clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Bring a folder's rows together; hot folders are split by the planner."""
    if not partition_by:
        return df
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add the rows of a query to a table of the same columns and types.

    A table that exists is compared with the query first; a query with other
    columns, or other types of stored columns, is an error and adds nothing.
    """
    where, files = _filesystem(df.sparkSession, path)
    if files.exists(where):
        stored = {f.name: f.dataType for f in df.sparkSession.read.parquet(path).schema.fields}
        added = {f.name: f.dataType for f in df.schema.fields}
        other = {
            name
            for name in stored.keys() | added.keys()
            # a folder's name does not tell its column's type
            if name not in stored
            or name not in added
            or (name not in partition_by and stored[name] != added[name])
        }
        if other:
            raise ValueError(f"the table has other columns: {', '.join(sorted(other))}")
    _clustered(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the result of a query as the table's whole content; read it back.

    The rows are written to a folder beside the table, and only when they are
    there does that folder take the table's place. So the query may read the
    table it replaces, a failed write leaves the old table, and running it twice
    leaves the same table, so a derivation can be repeated.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    staged = f"{path.rstrip('/')}.staged-{mark}"
    _clustered(df, partition_by).write.partitionBy(*partition_by).parquet(staged)
    fresh, files = _filesystem(spark, staged)
    target, _ = _filesystem(spark, path)
    old, _ = _filesystem(spark, f"{path.rstrip('/')}.old-{mark}")
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"{path} could not be set aside; the new rows are in {staged}")
    if not files.rename(fresh, target):
        if had:
            files.rename(old, target)
        raise OSError(f"{path} could not be replaced; the new rows are in {staged}")
    if had:
        files.delete(old, True)
    spark.catalog.refreshByPath(path)
    return read_table(spark, path, df.schema).select(*df.columns)


def append_numbered(
    df: DataFrame,
    path: str,
    order_by: Sequence[str | Column],
    into: str = "id",
    partition_by: Sequence[str] = (),
) -> None:
    """Add rows under ids that go on from the largest id of the table.

    The first load starts at 0. Within a load the ids follow ``order_by``, which
    must tell the rows apart. One load at a time: two at once would both go on
    from the same id.
    """
    spark = df.sparkSession
    where, files = _filesystem(spark, path)
    start = 0
    if files.exists(where):
        largest = spark.read.parquet(path).agg(F.max(into)).first()[0]
        start = 0 if largest is None else largest + 1
    append_rows(dense_ids(df, order_by, into, start), path, partition_by)


# --- rewriting a part of a table ----------------------------------------------------


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> list[str]:
    """Write ``df`` as the whole content of the partitions its rows fall into, and
    return these partitions' folders; the files of all others are not touched.

    All rows are written beside the table first, so ``df`` may read the table, and a
    failed write changes nothing. Then each new folder takes its partition's place.
    If the program dies meanwhile, :func:`finish_replacing` does the rest of the
    folders. The driver handles folder names only, as Spark's own commit does.
    """
    spark = df.sparkSession
    base = path.rstrip("/")
    staged = f"{base}.staged-{uuid.uuid4().hex}"
    _clustered(df, partition_by).write.partitionBy(*partition_by).parquet(staged)
    return _swap_in(spark, staged, base)


def finish_replacing(spark: SparkSession, path: str) -> list[str]:
    """Complete what a program that died had begun to put in place; return the
    folders. Writes that had not ended are left alone: their folder has no mark."""
    base = path.rstrip("/")
    where, files = _filesystem(spark, f"{base}.staged-*")
    done: list[str] = []
    for folder in files.globStatus(where) or []:
        staged = folder.getPath().toString()
        if files.exists(_filesystem(spark, f"{staged}/_SUCCESS")[0]):
            done += _swap_in(spark, staged, base)
    return done


def _folders(spark: SparkSession, root: str) -> list[str]:
    """The folders below ``root`` that hold data files, relative to it."""
    where, files = _filesystem(spark, root)
    start = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getPath().toString()
    found, found_files = set(), files.listFiles(where, True)
    while found_files.hasNext():
        name = found_files.next().getPath()
        if not name.getName().startswith(("_", ".")):
            found.add(name.getParent().toString()[len(start) :].strip("/"))
    return sorted(found)


def _swap_in(spark: SparkSession, staged: str, base: str) -> list[str]:
    """Move each folder of ``staged`` to its place. Can be run again at any point: a
    folder that has been moved is no longer in ``staged``."""
    names = _folders(spark, staged)
    for name in names:
        fresh, files = _filesystem(spark, f"{staged}/{name}")
        target, _ = _filesystem(spark, f"{base}/{name}")
        files.mkdirs(target.getParent())
        files.delete(target, True)
        if not files.rename(fresh, target):
            raise OSError(f"{staged}/{name} could not be put in place; finish_replacing tries again")
    where, files = _filesystem(spark, staged)
    files.delete(where, True)
    spark.catalog.refreshByPath(base)
    return names


def update_partitions(
    spark: SparkSession,
    path: str,
    schema: StructType,
    partition_by: Sequence[str],
    key: str,
    source: DataFrame,
    source_key: str,
    column: str,
    value: str,
) -> list[str]:
    """:func:`update_from` on a stored table, rewriting only the partitions that hold
    a key of ``source``; returns their folders.

    The touched partitions are found from the key column alone. ``source`` is
    written first, as it is read twice.
    """
    table = read_table(spark, path, schema)
    source = materialise(source.select(source_key, value), "update-source")
    keys = source.select(F.col(source_key).alias("_touched")).distinct()
    touched = table.join(keys, F.col(key) == F.col("_touched"), "left_semi")
    folders = [tuple(r) for r in touched.select(*partition_by).distinct().collect()]
    if not folders:
        return []
    one = [
        reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(partition_by, values, strict=True)])
        for values in folders
    ]
    part = table.where(reduce(or_, one))
    return replace_partitions(update_from(part, key, source, source_key, column, value), path, partition_by)


# --- deleting by file -----------------------------------------------------------------

#: Intervals that the deleted keys are described by.
INTERVALS = 64


def file_bounds(spark: SparkSession, path: str, schema: StructType, column: str) -> DataFrame:
    """``file``, ``low``, ``high``: the bounds of ``column`` in each file of a table.

    They are kept beside the table, and a call reads the column in those files only
    that it has not seen. Files without any value have NULL bounds.
    """
    base = path.rstrip("/")
    kept, files = _filesystem(spark, f"{base}.bounds-{column}")
    there = {re.sub("^file:/+", "file:/", f) for f in spark.read.schema(schema).parquet(base).inputFiles()}
    kind = StructType.fromDDL("file STRING").add("low", schema[column].dataType).add(
        "high", schema[column].dataType
    )
    known = spark.read.schema(kind).parquet(kept.toString()) if files.exists(kept) else None
    seen = {r["file"] for r in known.select("file").collect()} if known is not None else set()
    if there - seen:
        fresh = _of_files(spark, base, schema, sorted(there - seen))
        bounds = fresh.groupBy(_file_name().alias("file")).agg(
            F.min(column).alias("low"), F.max(column).alias("high")
        )
        bounds.write.mode("append").parquet(kept.toString())
        known = spark.read.schema(kind).parquet(kept.toString())
    here = literal_rows(spark, [(f,) for f in sorted(there)], StructType.fromDDL("file STRING"))
    return known.join(here, "file", "left_semi") if known is not None else here.limit(0).select(
        "file", F.lit(None).cast(schema[column].dataType).alias("low"), F.lit(None).cast(schema[column].dataType).alias("high")
    )


def _file_name() -> Column:
    """A row's file, named as ``inputFiles`` names it."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def _of_files(spark: SparkSession, base: str, schema: StructType, names: Sequence[str]) -> DataFrame:
    plain = [unquote(n) for n in names]  # Spark names files as URIs
    return spark.read.schema(schema).option("basePath", base).parquet(*plain)


def delete_in_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    column: str,
    keys: DataFrame,
    partition_by: Sequence[str] = (),
) -> list[str]:
    """Delete the rows whose ``column`` is in ``keys`` (one column) and return the
    files that were rewritten; all others stay as they are.

    1. Files whose bounds meet none of 64 intervals, which the sorted keys are cut
       into, are out (``file_bounds``).
    2. Of the rest, the key column tells the files that hold a deleted key.
    3. The remaining rows of these are written to new files, which are put in place
       before the old ones go. A reader in between may see both.

    NULL keys delete nothing. Keys that are clustered by file make this cheap; keys
    that are everywhere make it a rewrite of the table.
    """
    base = path.rstrip("/")
    gone = materialise(
        keys.toDF("_gone").where("_gone IS NOT NULL").distinct().withColumn("_gone", F.col("_gone").cast(schema[column].dataType)),
        "deleted-keys",
    )
    cut = gone.repartitionByRange(INTERVALS, "_gone").groupBy(F.spark_partition_id().alias("_cut"))
    spans = [tuple(r) for r in cut.agg(F.min("_gone").alias("a"), F.max("_gone").alias("b")).select("a", "b").collect()]
    if not spans:
        return []
    kind = schema[column].dataType
    bounds = file_bounds(spark, base, schema, column)
    near = reduce(
        or_, [(F.col("low") <= F.lit(b).cast(kind)) & (F.col("high") >= F.lit(a).cast(kind)) for a, b in spans]
    )
    names = [r["file"] for r in bounds.where(near).select("file").collect()]
    if not names:
        return []
    some = _of_files(spark, base, schema, sorted(names)).select(column, _file_name().alias("_file"))
    hit = some.join(gone, F.col(column) == F.col("_gone"), "left_semi").select("_file").distinct()
    hit = sorted(r["_file"] for r in hit.collect())
    if not hit:
        return []
    left = _of_files(spark, base, schema, hit).join(gone, F.col(column) == F.col("_gone"), "left_anti")
    staged = f"{base}.deleted-{uuid.uuid4().hex}"
    left.select(*schema.names).write.partitionBy(*partition_by).parquet(staged)
    where, files = _filesystem(spark, staged)
    start = files.getFileStatus(where).getPath().toString()
    listed, fresh = files.listFiles(where, True), []
    while listed.hasNext():
        name = listed.next().getPath()
        if not name.getName().startswith(("_", ".")):
            fresh.append(name)
    for name in fresh:
        target, _ = _filesystem(spark, f"{base}/{name.toString()[len(start) :].strip('/')}")
        files.mkdirs(target.getParent())
        if not files.rename(name, target):
            raise OSError(f"{name} could not be put in place; the old files are still there")
    for name in hit:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(unquote(name)), False)
    files.delete(where, True)
    spark.catalog.refreshByPath(base)
    return hit
