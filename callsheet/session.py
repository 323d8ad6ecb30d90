"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Broadcasts are never forced on tables: Catalyst broadcasts by file size and
# the adaptive planner by the measured size, and both fall back to a sort-merge
# join, or to a hash join where every measured partition of a side is small.
# forceOptimizeSkewedJoin lets a hot join key be split even if that costs a
# later shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: The temporary folders of local sessions, by application.
_TEMPORARY: dict[str, str] = {}


def build_session(
    app_name: str = "callsheet", master: str | None = None, **settings: str
) -> SparkSession:
    """A session with the settings above; ``settings`` (``a__b`` for ``a.b``) win."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    chosen = {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing, a local session gets a temporary folder once,
    which is removed when the program ends; a cluster gets an error, as a
    machine-local folder would not be shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = folder or _TEMPORARY.get(context.applicationId)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="callsheet-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _TEMPORARY[context.applicationId] = folder
    return folder.rstrip("/")


def workspace(spark: SparkSession) -> str:
    """This application's own folder in the shared folder: all that is written
    on the way goes there, and :func:`clear_workspace` removes it."""
    return f"{shared_folder(spark)}/callsheet-{spark.sparkContext.applicationId}"


def clear_workspace(spark: SparkSession) -> None:
    """Remove what this application has written on the way.

    For when its results have been read or stored: a DataFrame that still reads
    an intermediate fails afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(workspace(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def own_workspace(spark: SparkSession) -> Iterator[str]:
    """``with own_workspace(spark):`` clears the workspace at the end of the block."""
    try:
        yield workspace(spark)
    finally:
        clear_workspace(spark)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder in the workspace; read it back.

    The result has no lineage behind it: a lost executor costs a re-read, and
    values that depend on row placement stay as they were written.
    """
    path = f"{workspace(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
