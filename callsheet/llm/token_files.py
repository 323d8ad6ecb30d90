"""Token ids in Arrow files of equal-length sequences, and back."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsheet.llm.tokens import word_ids
from callsheet.session import materialise, workspace

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 64
INDEX = "part INT, file STRING, place BIGINT, doc_id BIGINT, at BIGINT, n_tokens BIGINT"


class TokenFile:
    """An Arrow file that takes ids in any portions and holds fixed-size lists.

    Each record batch has ``BATCH`` rows (the last one fewer) of ``ids``, a
    fixed-size list of ``SEQUENCE`` unsigned integers, and ``mask``, as many
    bits that tell ids from the padding of the last row. Buffers are not
    compressed, so a mapped file gives its ids without a copy, and the place of
    any id follows from its number alone.
    """

    def __init__(self, uri: str, id_type: pa.DataType):
        self.uri, self.id_type = uri, id_type
        self.schema = pa.schema(
            [("ids", pa.list_(id_type, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))]
        )
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(posixpath.dirname(path))
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= SEQUENCE * BATCH:
            self._write(whole=True)

    def _write(self, whole: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        step = SEQUENCE * BATCH
        end = len(ids) // step * step if whole else len(ids)
        for start in range(0, end, step):
            part = ids[start : min(start + step, end)]
            rows = -(-len(part) // SEQUENCE)
            padded = np.zeros(rows * SEQUENCE, self.id_type.to_pandas_dtype())
            padded[: len(part)] = part
            mask = np.zeros(rows * SEQUENCE, bool)
            mask[: len(part)] = True
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(padded), SEQUENCE),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE),
            ]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._write(whole=False)
        self.writer.close()
        self.sink.close()


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of a path on the file system that Spark would find it on: one without a
    scheme is on the default one, not on each executor's own disk."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()
    return re.sub("^file:/+", "file:///", uri)


def open_token_file(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of any batch; a local file is mapped, not read."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(fs.open_input_file(path))


def stored_ids(reader: pa.ipc.RecordBatchFileReader, at: int, n: int) -> np.ndarray:
    """The ids numbered ``at`` to ``at + n`` of a file; touches their batches only."""
    step, found = SEQUENCE * BATCH, []
    for number in range(at // step, -(-(at + n) // step)):
        ids = reader.get_batch(number).column(0).flatten().to_numpy()
        found.append(ids[max(0, at - number * step) : at + n - number * step])
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write all ids as files in
    ascending order of the key, and return the index: a row per document.

    The documents are sorted by ranges of the key; each task writes one file
    under a name of its own attempt, so what a lost or repeated attempt leaves
    behind is named by no index row. Ids take the smallest unsigned type that
    holds the vocabulary. The index is written too and holds ``part`` (range),
    ``file``, ``place``, key, ``at`` (first id in the file) and ``n_tokens``.

    A null text is an empty one and gives the end id alone; null keys come
    first; rows with one key follow their text's hash, repeated rows stay; no
    rows give no files. Other columns are not read.
    """
    folder = qualified(docs.sparkSession, f"{workspace(docs.sparkSession)}/token-files-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary)
        size = max(ids_of.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        id_type = pa.uint16() if size <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        file, at, place = None, 0, 0
        for batch in batches:
            if file is None and batch.num_rows:
                file = TokenFile(uri, id_type)
            counts = [np.empty(0, np.int64)]
            for ids, sizes in ids_of.of_texts(batch.column("text")):
                file.add(np.insert(ids, np.cumsum(sizes), end_id))
                counts.append(sizes + 1)
            n = np.concatenate(counts)
            starts = at + np.cumsum(n) - n
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, part, np.int32)),
                    pa.array([uri] * rows, pa.string()),
                    pa.array(np.arange(place, place + rows)),
                    batch.column("doc_id"),
                    pa.array(starts),
                    pa.array(n),
                ],
                names=["part", "file", "place", "doc_id", "at", "n_tokens"],
            )
            at, place = at + int(n.sum()), place + rows
        if file is not None:
            file.close()

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = chosen.withColumn("_hash", F.xxhash64("text"))
    ordered = hashed.orderBy("doc_id", "_hash", F.monotonically_increasing_id())
    return materialise(ordered.drop("_hash").mapInArrow(write, INDEX), "token-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Each document's ids out of the files: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids`` (little-endian, 4 bytes each).

    Only the files' totals (one row per range) are accumulated in one task.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    offsets = files.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for whole in batches:
            # a few documents at a time: their ids are much wider than the index
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ids = []
                for name, at, n in zip(
                    *(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True
                ):
                    if name != uri:
                        uri, reader = name, open_token_file(name)
                    ids.append(stored_ids(reader, at, n).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("start"),
                        batch.column("n_tokens"),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = index.join(F.broadcast(offsets), "part").select(
        "file", "doc_id", (F.col("_base") + F.col("at")).alias("start"), "at", "n_tokens"
    )
    return placed.mapInArrow(read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids BINARY")


def digests(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """The digest rows of the token file query."""
    stored = read_token_files(write_token_files(docs, vocabulary, end_id))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
