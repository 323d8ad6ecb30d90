"""Repeated byte strings by distributed prefix doubling over a sparse suffix array."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.words import mixed, sliding, stretches
from callsheet.session import materialise, workspace

#: Bytes of a window; of a gram; places of which the least gram is a cut.
WINDOW, GRAM, SPAN = 400, 16, 128
#: Bytes of texts, and rows, that a task gathers before it hands them on.
GATHERED_BYTES, GATHERED_ROWS = 32 << 20, 400_000

#: Bytes behind a window's first cut that always lie in the window.
REACH = WINDOW - (SPAN - 1)
#: Cells that a task gathers before it hands them on.
GATHERED_CELLS = 200_000
#: Texts that a task reads at a time.
READ_TEXTS = 256

#: A text: a hash, and a number that tells texts of the same hash apart.
TEXT = ["t", "u"]


# --- memory --------------------------------------------------------------------------

Batches = Iterator[pa.RecordBatch]


def _released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, with what it freed given back to the system at its end: workers stay,
    idle, beside the JVM while other stages run, and Arrow keeps for them what their
    largest task took."""

    @functools.wraps(run)
    def then_release(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return then_release


def _by_few(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` on a few texts at a time, so that what it makes of them is small, and
    released at its end."""

    @functools.wraps(run)
    def on_slices(batches: Batches) -> Batches:
        return run(b.slice(at, READ_TEXTS) for b in batches for at in range(0, b.num_rows, READ_TEXTS))

    return _released(on_slices)


# --- texts ---------------------------------------------------------------------------


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)]


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _packed(text: bytes) -> bytes:
    return pa.compress(text, codec="zstd", asbytes=True)


def _texts_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    sizes, packed = batch.column("n_bytes").to_pylist(), batch.column("packed").to_pylist()
    for size, data in zip(sizes, packed, strict=True):
        yield pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[dict[str, np.ndarray]]:
    """A column of lists of structs as a row's arrays, of the entries that are its
    text's own (texts of one hash share them)."""
    lists = batch.column(name)
    items, offsets = lists.values, np.asarray(lists.offsets)
    fields = {f.name: items.field(f.name).to_numpy() for f in items.type}
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    own = zip(batch.column("u").to_pylist(), offsets[:-1], offsets[1:], missing, strict=True)
    for u, start, end, none in own:
        here = np.arange(start, start if none else end)
        here = here[fields["u"][here] == u]
        yield {name: values[here] for name, values in fields.items() if name != "u"}


DISTINCT = "t BIGINT, t2 BIGINT, n_bytes INT, packed BINARY, ids ARRAY<BIGINT>"
STORED = "t BIGINT, u INT, weight INT, n_bytes INT, packed BINARY, ids ARRAY<BIGINT>"


@_by_few
def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts that a task meets are one row with all their keys."""
    held: dict[bytes, tuple[int, bytes, list]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        rows = list(held.items())
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            sizes, packed, ids = zip(*(row for _, row in part), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *_halves([digest for digest, _ in part]),
                    pa.array(list(sizes), pa.int32()),
                    pa.array(list(packed), pa.binary()),
                    pa.array(list(ids), pa.list_(pa.int64())),
                ],
                names=["t", "t2", "n_bytes", "packed", "ids"],
            )

    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            digest = _digest(text)
            if digest not in held:
                held[digest] = (len(text), _packed(text), [])
                size += len(held[digest][1]) + 100
            held[digest][2].append(key)
            size += 8
        if size >= GATHERED_BYTES:
            yield from hand_on()
            held.clear()
            size = 0
    yield from hand_on()


@_released
def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: the first of each text stands for it, with weight 2 if the text
    comes again, else 1; the others have weight 0. Texts of one hash are numbered."""
    last, number, held = None, 0, None

    def weighed(rows: pa.Table, following) -> Iterator[pa.RecordBatch]:
        nonlocal last, number
        t, t2 = rows.column("t").to_numpy(), rows.column("t2").to_numpy()
        same_hash = np.r_[last is not None and last[0] == t[0], t[1:] == t[:-1]]
        same = same_hash & np.r_[last is not None and last[1] == t2[0], t2[1:] == t2[:-1]]
        again = np.r_[same[1:], following == (t[-1], t2[-1])]
        many = np.diff(np.asarray(rows.column("ids").combine_chunks().offsets)) > 1
        # texts met since the last new hash; a hash that goes on keeps its number
        texts = np.cumsum(~same)
        base = np.maximum.accumulate(np.where(same_hash, 0, texts))
        u = texts - base
        if same_hash[0]:
            first_run = np.cumsum(~same_hash) == 0
            u = np.where(first_run, texts + number, u)
        last, number = (t[-1], t2[-1]), int(u[-1])
        weight = np.where(~same, np.where(again | many, 2, 1), 0)
        columns = {c: rows.column(c).combine_chunks() for c in ("n_bytes", "packed", "ids")}
        yield pa.RecordBatch.from_arrays(
            [pa.array(t), pa.array(u.astype(np.int32)), pa.array(weight.astype(np.int32)), *columns.values()],
            names=["t", "u", "weight", *columns],
        )

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                yield from weighed(held, (rows["t"][0].as_py(), rows["t2"][0].as_py()))
            held = rows
    if held is not None:
        yield from weighed(held, None)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct texts of every task, compressed, in a table bucketed by their
    hash, so that what is found about texts is joined to them again without a
    shuffle of texts."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_distinct, DISTINCT).repartition(buckets, "t").sortWithinPartitions("t", "t2")
    name = f"texts_{uuid.uuid4().hex}"
    dealt.mapInArrow(_leading, STORED).write.bucketBy(buckets, "t").option(
        "path", f"{workspace(spark)}/{name}"
    ).saveAsTable(name)
    return spark.table(name)


# --- keys that come twice --------------------------------------------------------------


def _combined(keys: list[str]) -> Callable:
    """A task's rows by key: the first carries the weight of all, the others are
    known to come again and go anywhere."""

    @_released
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not size:
                return
            rows = pa.Table.from_batches(held)
            values = [rows.column(k).to_numpy() for k in keys]
            order = np.lexsort(values[::-1])
            rows = rows.take(pa.array(order))
            values = [v[order] for v in values]
            fresh = np.r_[True, np.any([v[1:] != v[:-1] for v in values], axis=0)]
            starts = np.flatnonzero(fresh)
            weight = np.zeros(size, np.int64)
            weight[starts] = np.add.reduceat(rows.column("weight").to_numpy(), starts)
            anywhere = mixed(values[0].view(np.uint64) + np.arange(size, dtype=np.uint64)).view(np.int64)
            rows = rows.set_column(rows.schema.get_field_index("weight"), "weight", pa.array(weight))
            rows = rows.add_column(0, "passed", pa.array(~fresh))
            rows = rows.add_column(0, "route", pa.array(np.where(fresh, values[0], anywhere)))
            wanted = fresh | rows.column("asks").to_numpy()
            yield from rows.filter(pa.array(wanted)).combine_chunks().to_batches(1 << 16)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= GATHERED_ROWS:
                yield from hand_on()
                held.clear()
                size = 0
        yield from hand_on()

    return combine


def _twice(keys: list[str], names: list[str]) -> Callable:
    """Of rows sorted by key, those that ask and whose key weighs 2 or more. A run of
    a key has at most a row from each portion of a task."""

    def select(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        passed = rows.column("passed").to_numpy()
        values = [rows.column(k).to_numpy() for k in keys]
        fresh = np.r_[True, passed[1:] | np.any([v[1:] != v[:-1] for v in values], axis=0)]
        starts = np.flatnonzero(fresh)
        total = np.add.reduceat(rows.column("weight").to_numpy(), starts)
        total = np.repeat(total, np.diff(np.r_[starts, rows.num_rows]))
        kept = (passed | (total >= 2)) & rows.column("asks").to_numpy()
        yield from rows.filter(pa.array(kept)).select(names).combine_chunks().to_batches(1 << 16)

    @_released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 16:
                rows = pa.Table.from_batches(held)
                values = [rows.column(k).to_numpy() for k in [*keys, "passed"]]
                cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0))
                if len(cuts):
                    cut = int(cuts[-1]) + 1
                    yield from select(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    size -= cut
        if held:
            yield from select(pa.Table.from_batches(held))

    return run


def coming_twice(rows: DataFrame, keys: list[str], refs: str) -> DataFrame:
    """``refs`` (columns) of the rows that ask and whose key has a ``weight`` of 2 or
    more in all of ``rows`` (``keys``, ``weight``, ``asks``, and the columns of refs).
    A key that comes often reaches its group with a row from each portion of a task."""
    columns = ", ".join(f"{k} BIGINT" for k in keys)
    schema = f"route BIGINT, passed BOOLEAN, {columns}, weight BIGINT, asks BOOLEAN, {refs}"
    names = [r.split()[0] for r in refs.split(", ")]
    wanted = rows.select(*keys, F.col("weight").cast("long"), "asks", *names)
    dealt = wanted.mapInArrow(_combined(keys), schema).repartition("route")
    return dealt.sortWithinPartitions("passed", *keys).mapInArrow(_twice(keys, names), refs)


# --- cuts, phrases, cells ----------------------------------------------------------------


def cuts_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams' hashes by place, the least of each 128 of them, and the cuts: the
    places whose gram is the least of some 128. What a text is around a cut decides
    on it, so equal strings have equal cuts, but for those near their ends."""
    grams = stretches(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), GRAM)
    least = sliding(grams, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    reach = sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    return grams, least, np.flatnonzero(reach == grams)


AHEAD = "key BIGINT, weight INT, asks BOOLEAN, t BIGINT, u INT, i INT"


@_by_few
def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cut the hash of the bytes behind it that a window holds, whose first
    cut it is."""
    for batch in batches:
        keys: list[int] = []
        counts = []
        for text in _texts_of(batch):
            cuts = cuts_of(text)[2]
            cuts = cuts[cuts <= len(text) - REACH].tolist()
            keys += [xxhash.xxh3_64_intdigest(text[c : c + REACH]) for c in cuts]
            counts.append(len(cuts))
        repeated = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("weight", "t", "u")]
        if keys:
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(repeated[0]),
                    pa.array(np.ones(len(keys), bool)),
                    pa.array(repeated[1]),
                    pa.array(repeated[2]),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
                ],
                names=["key", "weight", "asks", "t", "u", "i"],
            )
            for at in range(0, len(keys), 1 << 16):
                yield whole.slice(at, 1 << 16)


def _settled(at: np.ndarray, grams: np.ndarray, cuts: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
    """Moves cut numbers by ``step`` until their grams have the values."""
    wrong = np.flatnonzero(grams[cuts[at]] != value)
    while len(wrong):
        at[wrong] += step
        wrong = wrong[grams[cuts[at[wrong]]] != value[wrong]]
    return at


def cells_of(text: bytes, found: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The cuts of a text, and its cells: stretches of windows (first, number less
    one) that have the same first and last cut (their numbers) of those that the
    window itself decides on, where the first is in ``found``. Only such windows can
    come again."""
    grams, least, cuts = cuts_of(text)
    known = np.zeros(len(cuts), bool)
    known[found] = True
    near = np.zeros(len(text) + 1, np.int64)
    np.add.at(near, np.maximum(cuts[known] - (SPAN - 1), 0), 1)
    np.add.at(near, cuts[known] + 1, -1)
    starts = np.flatnonzero(np.cumsum(near)[: len(text) - WINDOW + 1] > 0)
    first = _settled(np.searchsorted(cuts, starts), grams, cuts, least[starts], 1)
    starts, first = starts[known[first]], first[known[first]]
    if not len(starts):
        return cuts, []
    ends = starts + (WINDOW - GRAM)
    last = np.searchsorted(cuts, ends, "right") - 1
    last = _settled(last, grams, cuts, least[ends - SPAN + 1], -1)
    fresh = np.r_[True, (np.diff(starts) > 1) | (np.diff(first) > 0) | (np.diff(last) > 0)]
    rows = np.flatnonzero(fresh)
    more = np.diff(np.r_[rows, len(starts)]) - 1
    return cuts, list(zip(*(x.tolist() for x in (starts[rows], more, first[rows], last[rows])), strict=True))


FOUND = (
    "kind INT, t BIGINT, u INT, weight INT, x1 BIGINT, x2 BIGINT,"
    " at INT, more INT, lead INT, first INT, last INT, level INT"
)
CELL, CERTAIN = 1, 2


@_by_few
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the cells. Of cells with equal bytes that a task meets the first
    stands for all, with weight 2; the others are known to come again (``CERTAIN``,
    joined into spans)."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64() if n in ("t", "x1", "x2") else pa.int32() for n in names]
    seen: dict[tuple, list] = {}
    certain: list[list] = []

    def hand_on() -> Iterator[pa.RecordBatch]:
        every = [(CELL, *row[1:], row[0]) for row in seen.values()]
        every += [(CERTAIN, t, u, 2, at, more, 0, 0, 0, 0, bytes(16)) for t, u, at, more in certain]
        for at in range(0, len(every), 1 << 15):
            *values, contents = zip(*every[at : at + (1 << 15)], strict=True)
            values[4:4] = _halves(list(contents))
            columns = zip(values, kinds, strict=True)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(list(c), k) for c, k in columns], names=names
            )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("t", "u", "weight"))
        lists = _lists(batch, "found")
        for t, u, weight, found, text in zip(*columns, lists, _texts_of(batch), strict=True):
            cuts, cells = cells_of(text, found["i"])
            open_span = None
            for at, more, a, b in cells:
                lead = int(cuts[a]) - at
                digest = _digest(text[at : at + more + WINDOW])
                key = (digest, lead, more)
                if key not in seen:
                    level = (b - a).bit_length() - 1
                    seen[key] = [digest, t, u, weight, at, more, lead, a, b, level]
                    continue
                seen[key][3] = 2
                if open_span and open_span[2] + open_span[3] + 1 == at:
                    open_span[3] += more + 1
                else:
                    open_span = [t, u, at, more]
                    certain.append(open_span)
        if len(seen) + len(certain) >= GATHERED_CELLS:
            yield from hand_on()
            seen.clear()
            certain.clear()
    yield from hand_on()


PHRASES = "t BIGINT, u INT, i INT, size INT, weight INT, r1 BIGINT, r2 BIGINT"


@_by_few
def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of cells, by their content, with the number of phrases from there
    on that a window could hold, with one at its edge."""
    names = [c.split()[0] for c in PHRASES.split(", ")]
    for batch in batches:
        contents: list[bytes] = []
        held = []
        columns = (batch.column(c).to_pylist() for c in ("t", "u"))
        for t, u, cells, text in zip(*columns, _lists(batch, "cells"), _texts_of(batch), strict=True):
            if not len(cells["first"]):
                continue
            cuts = cuts_of(text)[2]
            used, heavy = np.zeros((2, len(cuts) + 1), np.int64)
            for step, some in ((used, slice(None)), (heavy, cells["total"] > 1)):
                np.add.at(step, cells["first"][some], 1)
                np.add.at(step, cells["last"][some], -1)
            i = np.flatnonzero(np.cumsum(used) > 0)
            size = np.minimum(np.searchsorted(cuts, cuts[i + 1] + WINDOW) - i, len(cuts) - 1 - i)
            weight = (np.cumsum(heavy)[i] > 0) + 1
            contents += [_digest(text[a:b]) for a, b in zip(cuts[i].tolist(), cuts[i + 1].tolist(), strict=True)]
            held.append((np.full(len(i), t, np.int64), np.full(len(i), u), i, size, weight))
        if contents:
            t, *small = (np.concatenate(c) for c in zip(*held, strict=True))
            arrays = [pa.array(t), *(pa.array(c.astype(np.int32)) for c in small), *_halves(contents)]
            whole = pa.RecordBatch.from_arrays(arrays, names=names)
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)


# --- doubling ------------------------------------------------------------------------------


def _reranked(pairs: DataFrame) -> DataFrame:
    """``pairs`` (r1, r2) get their place among the sorted distinct pairs that weigh
    2 or more as ``rank``; positions of unique pairs go."""
    twice = pairs.groupBy("r1", "r2").agg(F.sum("weight").alias("w")).where("w >= 2")
    ranks = materialise(
        twice.select("r1", "r2").orderBy("r1", "r2").select("*", F.monotonically_increasing_id().alias("rank")),
        "ranks",
    )
    return materialise(pairs.join(ranks, ["r1", "r2"]).drop("r1", "r2"), "ranked-positions")


def doubled_ranks(positions: DataFrame) -> list[DataFrame]:
    """Ranks of the next 1, 2, 4, ... phrases of each position (``t1``, ``t2``, ``i``,
    ``size``, ``weight``, and the phrase's content as r1, r2), while they come twice
    and are no longer than ``size`` phrases, those a window can hold.

    Each round pairs a position's rank with that of the position as many phrases on,
    sorts the pairs and numbers those that come again."""
    levels, reach = [_reranked(positions)], 1
    while True:
        ahead = Window.partitionBy(*TEXT).orderBy("i").rangeBetween(reach, reach)
        pairs = (
            levels[-1]
            .select(*TEXT, "i", "size", "weight", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2"))
            .where((F.col("size") >= 2 * reach) & F.col("r2").isNotNull())
        )
        pairs = materialise(pairs, "rank-pairs")
        if pairs.isEmpty():
            return levels
        levels.append(_reranked(pairs))
        reach *= 2


# --- windows ---------------------------------------------------------------------------------


WINDOWS = "g1 BIGINT, g2 BIGINT, weight INT, asks BOOLEAN, cell BIGINT, inner INT"


@_by_few
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of cells (numbered, so that a window's row is small)."""
    for batch in batches:
        digests: list[bytes] = []
        held: list[dict[str, np.ndarray]] = []
        for cells, text in zip(_lists(batch, "cells"), _texts_of(batch), strict=True):
            for at, more in zip(cells["at"].tolist(), cells["more"].tolist(), strict=True):
                digests += [_digest(text[p : p + WINDOW]) for p in range(at, at + more + 1)]
            held.append(cells)
        if digests:
            cell, more, total = (np.concatenate([h[c] for h in held]) for c in ("cell", "more", "total"))
            ends = np.cumsum(more + 1)
            inner = np.arange(ends[-1]) - np.repeat(ends - more - 1, more + 1)
            total = np.repeat(total, more + 1)
            whole = pa.RecordBatch.from_arrays(
                [
                    *_halves(digests),
                    pa.array(np.minimum(total, 2).astype(np.int32)),
                    pa.array(total == 1),
                    pa.array(np.repeat(cell, more + 1)),
                    pa.array(inner.astype(np.int32)),
                ],
                names=["g1", "g2", "weight", "asks", "cell", "inner"],
            )
            for k in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(k, 1 << 16)


RESULT = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept BINARY"


@_by_few
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        lists = _lists(batch, "repeated")
        for ids, repeated, text in zip(batch.column("ids").to_pylist(), lists, _texts_of(batch), strict=True):
            removed = spans = 0
            kept = text
            at = repeated["at"].astype(np.int64)
            if len(at):
                step = np.bincount(at, minlength=len(text) + 1)
                step -= np.bincount(at + repeated["more"] + WINDOW, minlength=len(text) + 1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for key in ids:
                rows.append((key, len(text), removed, spans, kept))
            while len(rows) >= 1000:
                yield _results(rows[:1000])
                rows = rows[1000:]
        if rows:
            yield _results(rows)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in columns], names=[c.split()[0] for c in RESULT.split(", ")]
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``n_bytes`` of its text in UTF-8,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the bytes outside
    all 400-byte strings that start anywhere else, too, in the same text or another.

    A suffix array of all bytes would be many times as large as the texts, so it is
    sparse: only suffixes at cuts (``cuts_of``) are ranked, a few in each window.

    1. Every window holds the 273 bytes behind its first cut. Cuts behind which these
       come once, by their 64-bit hash, bear no repeats.
    2. The other windows are in cells: stretches of windows with the same first and
       last cut. Cells that are equal in all their bytes (128 bits of hash) have only
       repeated windows, and one stands for all.
    3. What is left are cells that differ, if only at their edges. The phrases between
       their cuts are ranked by content, and prefix doubling ranks the suffixes over
       2, 4, 8, ... phrases, until they are unique or longer than a window
       (``doubled_ranks``). A cell's phrases are covered by two ranked runs. The
       windows of cells that agree in both are compared one by one, by 128 bits of
       hash; all others are unique.
    4. Repeated windows are cut from their texts.

    Equal texts of a task are one row, and equal cells and keys are counted in each
    task before every shuffle. Rows with null or empty texts have no bytes; texts
    below 400 bytes lose none; repeated rows repeat each other, and null keys are
    keys like others; no rows give no rows. Other columns are not read. A table with
    the texts, bucketed by hash, stays in the session's catalog and the workspace.
    """
    texts = _texts(docs, key, text)
    leading = texts.where((F.col("weight") > 0) & (F.col("n_bytes") >= WINDOW)).drop("ids")
    again = coming_twice(leading.mapInArrow(_ahead, AHEAD), ["key"], "t BIGINT, u INT, i INT")
    known = again.groupBy("t").agg(F.collect_list(F.struct("u", "i")).alias("found"))
    found = materialise(leading.join(known, "t").mapInArrow(_cells, FOUND), "cells")

    cells, content = found.where(F.col("kind") == CELL), ["x1", "x2", "more", "lead"]
    ref = F.struct(*TEXT, "at", "first", "last", "level")
    hulls = materialise(
        cells.groupBy(*content).agg(F.sum("weight").alias("total"), F.min(ref).alias("ref")),
        "cell-contents",
    )
    sure = cells.join(hulls.where("total >= 2").select(*content), content).select(*TEXT, "at", "more")
    sure = sure.union(found.where(F.col("kind") == CERTAIN).select(*TEXT, "at", "more"))

    standing = hulls.select("ref.*", "more", "total")
    of_text = standing.groupBy("t").agg(
        F.collect_list(F.struct("u", "first", "last", "total")).alias("cells")
    )
    positions = materialise(leading.join(of_text, "t").mapInArrow(_phrases, PHRASES), "phrases")
    ranks = None
    for level, ranked in enumerate(doubled_ranks(positions)):
        here = ranked.select(*TEXT, "i", F.lit(level).alias("level"), "rank")
        ranks = here if ranks is None else ranks.union(here)
    head = ranks.withColumnsRenamed({"rank": "head", "i": "first"})
    tail = ranks.withColumnsRenamed({"rank": "tail", "i": "other"})
    runs = (
        standing.withColumn("other", F.col("last") - F.expr("shiftleft(1, level)"))
        .withColumn("size", F.col("last") - F.col("first"))
        .join(head, [*TEXT, "first", "level"])
        .join(tail, [*TEXT, "other", "level"])
    )
    run = ["size", "head", "tail"]
    runs = materialise(runs.select(*run, *TEXT, "at", "more", "total"), "ranked-cells")
    several = materialise(runs.groupBy(*run).agg(F.count("*").alias("cells")).where("cells > 1"), "open-runs")
    asked = runs.join(several.drop("cells"), run).select(
        F.monotonically_increasing_id().alias("cell"), *TEXT, "at", "more", "total"
    )
    asked = materialise(asked, "open-cells")
    of_text = asked.groupBy("t").agg(
        F.collect_list(F.struct("u", "cell", "at", "more", "total")).alias("cells")
    )
    windows = leading.join(of_text, "t").mapInArrow(_windows, WINDOWS)
    hits = coming_twice(windows, ["g1", "g2"], "cell BIGINT, inner INT")
    hits = hits.join(asked.select("cell", *TEXT, "at"), "cell")
    spans = sure.union(hits.select(*TEXT, F.col("at") + F.col("inner"), F.lit(0).alias("more")))
    repeated = spans.groupBy("t").agg(F.collect_list(F.struct("u", "at", "more")).alias("repeated"))
    return texts.join(repeated, "t", "left").mapInArrow(_cut, RESULT)


def digests(docs: DataFrame) -> DataFrame:
    """The rows of the query."""
    return without_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
