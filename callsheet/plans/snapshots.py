"""Stored views that know which files they were made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from callsheet.sources.tables import _filesystem, literal_rows, replace_table

Make = Callable[[Mapping[str, DataFrame]], DataFrame]
SOURCES = StructType().add("source", "string").add("fingerprint", "string")


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files; none is opened."""
    where, files = _filesystem(spark, path)
    found = []
    if files.exists(where):
        listed = files.listFiles(where, True)
        while listed.hasNext():
            file = listed.next()
            name = file.getPath()
            if not name.getName().startswith(("_", ".")):
                found.append(f"{name.toString()}:{file.getLen()}:{file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


class Snapshots:
    """Views over stored tables, written below ``path``, each with the fingerprints of
    what it read.

    :meth:`table` names a base table's folder; :meth:`view` a view, its sources (tables
    or earlier views), and the function that makes it from their DataFrames.
    :meth:`refresh` makes a view anew where a source's files have changed since, or a
    view it reads was made anew, and leaves all others alone: for these no table is
    read, only folders are listed. A view's rows are put in place before its
    fingerprints, so a refresh that died is done again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._tables: dict[str, tuple[str, StructType | None]] = {}
        self._views: dict[str, tuple[list[str], Make]] = {}

    def table(self, name: str, path: str, schema: StructType | None = None) -> Snapshots:
        self._new(name)
        self._tables[name] = (path, schema)
        return self

    def view(self, name: str, sources: Sequence[str], make: Make) -> Snapshots:
        self._new(name)
        unknown = [s for s in sources if s not in self._tables and s not in self._views]
        if unknown:
            raise ValueError(f"{name} reads {', '.join(unknown)}, which must be named before")
        self._views[name] = (list(sources), make)
        return self

    def stale(self) -> list[str]:
        """The views that a refresh would make anew."""
        found: list[str] = []
        for name, (sources, _) in self._views.items():
            if any(s in found for s in sources) or self._kept(name) != self._now(sources):
                found.append(name)
        return found

    def refresh(self) -> list[str]:
        """Make the stale views anew, in the order they were named; return their names."""
        done = []
        for name, (sources, make) in self._views.items():
            now = self._now(sources)
            if self._kept(name) == now:
                continue
            replace_table(make({s: self.read(s) for s in sources}), self._folder(name))
            marks = literal_rows(self.spark, sorted(now.items()), SOURCES)
            replace_table(marks.coalesce(1), f"{self._folder(name)}.sources")
            done.append(name)
        return done

    def read(self, name: str) -> DataFrame:
        """A table, or a view as it was last made."""
        if name in self._views:
            return self.spark.read.parquet(self._folder(name))
        path, schema = self._tables[name]
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)

    def _new(self, name: str) -> None:
        if name in self._tables or name in self._views:
            raise ValueError(f"{name} is named already")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _now(self, sources: Sequence[str]) -> dict[str, str]:
        paths = {s: self._folder(s) if s in self._views else self._tables[s][0] for s in sources}
        return {s: fingerprint(self.spark, path) for s, path in paths.items()}

    def _kept(self, name: str) -> dict[str, str] | None:
        marks, files = _filesystem(self.spark, f"{self._folder(name)}.sources")
        if not files.exists(marks):
            return None
        rows = self.spark.read.schema(SOURCES).parquet(marks.toString()).collect()
        return {r["source"]: r["fingerprint"] for r in rows}
