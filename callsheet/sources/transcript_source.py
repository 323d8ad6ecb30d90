"""Transcripts as a data source: splits of one file, with turns across their borders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.sources.tables import _filesystem
from callsheet.sources.transcripts import (
    BEFORE_COLON,
    BRACKETED,
    PART_IN_FILE_NAME,
    turn_columns,
    unescaped,
)

SCHEMA = "source_file STRING, position BIGINT, part_text STRING, value STRING, more ARRAY<STRING>, reject STRING"
#: Bytes of a split.
SPLIT_BYTES = 64 << 20


def transcript_source() -> type:
    """The data source ``transcript``. Its classes are made here, so that Python workers
    get them with the query and need not find this package."""
    import re

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema, head_form, bracketed = SCHEMA, BEFORE_COLON, BRACKETED

    class Split(InputPartition):
        def __init__(self, uri, name, start, end):
            self.uri, self.name, self.start, self.end = uri, name, start, end

    class Reader(DataSourceReader):
        """A split owns the lines that start in it, but for leading continuations, and
        the continuations of its last line, wherever they end."""

        def __init__(self, options):
            self.root = options["path"]
            self.size = int(options["splitbytes"])
            self.pattern = re.compile(options["partpattern"])
            self.head, self.bracketed = re.compile(head_form, re.ASCII), re.compile(bracketed, re.ASCII)
            self.ends = re.compile(b"\r\n|\n|\r")

        def partitions(self):
            import pyarrow.fs

            files, path = pyarrow.fs.FileSystem.from_uri(self.root)
            found = files.get_file_info(path)
            if found.type != pyarrow.fs.FileType.File:
                found = files.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
            prefix = self.root[: self.root.index(path)] if path in self.root else ""
            splits = []
            for info in found if isinstance(found, list) else [found]:
                if info.type == pyarrow.fs.FileType.File and not info.base_name.startswith(("_", ".")):
                    for start in range(0, info.size, self.size):
                        end = min(info.size, start + self.size)
                        splits.append(Split(prefix + info.path, prefix + info.path, start, end))
            return splits or [Split(None, None, 0, 0)]

        def lines(self, file, at):
            """Offset and bytes of each line, from a place on."""
            file.seek(at)
            held, begin = b"", 0
            while True:
                end = self.ends.search(held, begin)
                # a return at the end of what was read may be half of a line's end
                if end and not (end.end() == len(held) and held.endswith(b"\r")):
                    yield at + begin, held[begin : end.start()]
                    begin = end.end()
                    continue
                more = file.read(1 << 20)
                if not more:
                    if end:
                        yield at + begin, held[begin : end.start()]
                    elif begin < len(held):
                        yield at + begin, held[begin:]
                    return
                held, at, begin = held[begin:] + more, at + begin, 0

        def kind(self, line):
            if not line.replace("\t", " ").strip(" "):
                return "blank"
            head, colon, _ = line.partition(":")
            if colon and self.head.search(head):
                return "turn"
            return "direction" if self.bracketed.search(line) else "more"

        def read(self, split):
            if split.uri is None:
                return
            import pyarrow.fs

            files, path = pyarrow.fs.FileSystem.from_uri(split.uri)
            part = self.pattern.search(split.name)
            part = part.group(1) if part else ""
            unit = None  # offset, kind, line, continuations
            leading = split.start == 0

            def rows(unit):
                at, kind, line, more = unit
                if kind == "turn":
                    yield split.name, at, part, line, more, None
                    return
                yield split.name, at, part, line, [], kind
                for n, other in enumerate(more):
                    yield split.name, at + n + 1, part, other, [], "no speaker"

            with files.open_input_file(path) as file:
                found = self.lines(file, max(0, split.start - 1))
                if split.start:
                    next(found, None)  # the line before, or the rest of one
                for at, raw in found:
                    line = raw.decode("utf-8", "replace")
                    kind = "no part" if not part else self.kind(line)
                    if kind != "more":
                        if unit:
                            yield from rows(unit)
                        unit, leading = None, False
                        if at >= split.end:
                            break
                        unit = at, kind, line, []
                    elif unit:
                        unit[3].append(line)
                    elif leading:
                        yield split.name, at, part, line, [], "no speaker"
                if unit:
                    yield from rows(unit)

    class Transcripts(DataSource):
        @classmethod
        def name(cls):
            return "transcript"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader({k.lower(): v for k, v in self.options.items()})

    return Transcripts


def read_transcript_source(
    spark: SparkSession,
    path: str,
    parts: Sequence[int] | None = None,
    part_pattern: str = PART_IN_FILE_NAME,
    escapes: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """The turns and the rejects of :func:`read_transcripts`, from one scan.

    Files are read in splits of ``split_bytes``, each by a task of its own. A split
    owns the lines that start in it; it reads on to the end of its last turn, and
    leaves the continuation lines at its start to the split before. So a turn is
    whole where it is read: nothing is shuffled, sorted or written. A place in a file
    is its ``position`` in bytes (for rejects behind a line that is no turn, the
    number of lines behind it is added).

    Lines end with a line feed, a return, or both; bytes that are no UTF-8 become
    replacement marks. The file system must be one that Arrow can open.
    """
    spark.dataSource.register(transcript_source())
    where, files = _filesystem(spark, path)
    uri = re.sub("^file:/+", "file:///", files.makeQualified(where).toUri().toString())
    found = (
        spark.read.format("transcript")
        .option("partPattern", part_pattern)
        .option("splitBytes", str(split_bytes))
        .load(uri)
    )
    if parts is not None:
        wanted = F.col("part_text").isin(*[str(p) for p in parts])
        found = found.withColumn("out", ~wanted)
    else:
        found = found.withColumn("out", F.lit(False))
    lost = F.col("reject").isNotNull()
    lines = F.when(lost, F.array("value")).otherwise(F.concat(F.array("value"), "more"))
    rejects = found.where(lost | F.col("out")).select(
        "source_file",
        "position",
        F.explode(lines).alias("value"),
        F.when(F.col("out"), "no part").otherwise(F.col("reject")).alias("reject"),
    )
    spoken, said = turn_columns(escapes)
    text = F.array_join(F.concat(F.array(spoken), "more"), "\n")
    turns = found.where(~lost & ~F.col("out")).select(
        F.col("part_text").cast("int").alias("source_part"),
        "source_file",
        "position",
        *[column.alias(name) for name, column in said.items()],
        (unescaped(text) if escapes else text).alias("text"),
        (F.size("more") + 1).cast("long").alias("n_lines"),
    )
    return turns, rejects
