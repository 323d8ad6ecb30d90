"""Best-fit packing by a linear grouping scheme over the lengths' histogram."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.common import ordered_prefixes
from callsheet.llm.tokens import word_ids
from callsheet.session import materialise

PIECE = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"

#: Lengths above 1/16 of a sequence are grouped, the others fill what is left.
SMALL = 16
GROUPS = 96
#: Group sizes are rounded up to multiples of this.
GRAIN = 4


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key="doc_id", text="text"
) -> DataFrame:
    """Ids of whole texts with the end id, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary)
        for batch in batches:
            rows, docs_here = [], iter(batch.column("doc_id").to_pylist())
            for found, sizes in ids_of.of_texts(batch.column("text")):
                ends = np.cumsum(sizes + 1).tolist()
                every = memoryview(np.insert(found, np.cumsum(sizes), end_id).tobytes())
                for start, stop in zip([0, *ends], ends):
                    doc = next(docs_here)
                    for number, at in enumerate(range(start, stop, capacity)):
                        part = every[4 * at : 4 * min(at + capacity, stop)]
                        rows.append((doc, number, at - start, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(cut, PIECE)


# --- the plan: from histograms of at most ``capacity`` lengths ----------------


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken by the most valuable configuration."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small_first, worth = sizes[order], values[order]
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        fits = np.searchsorted(small_first, room, side="right")
        if fits:
            sums = best[room - small_first[:fits]] + worth[:fits]
            top = int(np.argmax(sums))
            if sums[top] > best[room] + 1e-12:
                best[room], choice[room] = sums[top], top
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[order[choice[room]]] += 1
            room -= small_first[choice[room]]
    return pattern


def configurations(sizes: list[int], counts: list[int], capacity: int):
    """Pairs of a configuration (how many of each size) and its number of
    sequences, that hold ``counts`` items: a linear program over configurations,
    solved by generating columns, rounded down, the rest first-fit decreasing."""
    size, need = np.array(sizes), np.array(counts, float)
    basis = np.diag(capacity // size).astype(float)
    amount = need / (capacity // size)
    for _ in range(60 * len(sizes)):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_pattern(np.maximum(dual, 0), size, capacity).astype(float)
        if column @ dual <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[leaves] * change, 0)
        amount[leaves] = ratio[leaves]
        basis[:, leaves] = column
    left, found = np.array(counts), []
    for number, column in zip(np.floor(amount + 1e-9).astype(int), basis.T.astype(int)):
        if number > 0:
            used = np.flatnonzero(column)
            number = min(number, *(left[used] // column[used]))
            if number > 0:
                left = left - number * column
                found.append((column, int(number)))
    while left.any():
        column, room = np.zeros(len(sizes), int), capacity
        for i in np.argsort(-size, kind="stable"):
            column[i] = min(left[i], room // size[i])
            room -= column[i] * size[i]
        used = np.flatnonzero(column)
        number = int(min(left[used] // column[used]))
        left = left - number * column
        found.append((column, number))
    return found


def large_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS):
    """Runs ``(begin, end, first sequence)`` for the large lengths ranked from the
    longest, and the number of sequences: rank ``r`` of a run goes to sequence
    ``first + r - begin``.

    Whole pieces have a sequence each. The others are split into groups of
    equal cardinality; each group's size is that of its longest, and the groups
    fill the configurations with actual pieces, which are never longer.
    """
    full = histogram.get(capacity, 0)
    runs = [(0, full, 0)] if full else []
    lengths = sorted((n for n in histogram if capacity // SMALL < n < capacity), reverse=True)
    total = sum(histogram[n] for n in lengths)
    if not total:
        return runs, full
    ends = np.cumsum([histogram[n] for n in lengths])
    bounds = sorted({total * g // groups for g in range(groups + 1)})
    sizes, counts, begins = [], [], []
    for begin, end in zip(bounds, bounds[1:]):
        longest = lengths[int(np.searchsorted(ends, begin, side="right"))]
        size = min(-(-longest // GRAIN) * GRAIN, capacity) // GRAIN
        if sizes and sizes[-1] == size:
            counts[-1] += end - begin
        else:
            sizes.append(size)
            counts.append(end - begin)
            begins.append(begin)
    at, sequence = [full + b for b in begins], full
    for column, number in configurations(sizes, counts, capacity // GRAIN):
        for group in np.flatnonzero(column):
            for _ in range(column[group]):
                runs.append((at[group], at[group] + number, sequence))
                at[group] += number
        sequence += number
    return sorted(runs), sequence


def small_plan(small: dict[int, int], gaps: dict[int, int], capacity: int):
    """Runs ``(begin, end, first bin)`` for the small lengths ranked from the
    longest, and the number of bins: rank ``r`` goes to bin ``first + r - begin``.

    Bins are the gaps ranked from the smallest, then new, empty ones. Each
    length goes to the smallest gap that holds it; all bins with one gap are
    handled at once, so the steps follow the numbers of lengths and gaps.
    """
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    bins = 0
    for gap in sorted(gaps):
        waiting[gap].append((bins, gaps[gap]))
        bins += gaps[gap]
    order, rank, runs = sorted(waiting), 0, []

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap not in waiting:
            bisect.insort(order, gap)
        waiting[gap].append(run)

    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            place = bisect.bisect_left(order, length)
            if place == len(order):
                each = capacity // length
                number = max(1, left // each)
                put(capacity, (bins, number))
                bins += number
                continue
            gap = order[place]
            first, number = waiting[gap].pop()
            used = min(number, left)
            if used < number:
                waiting[gap].append((first + used, number - used))
            if not waiting[gap]:
                del waiting[gap]
                order.pop(place)
            runs.append((rank, rank + used, first))
            rank, left = rank + used, left - used
            if gap > length:
                put(gap - length, (first, used))
    return runs, bins


def _by_runs(df: DataFrame, runs, into: str) -> DataFrame:
    """Add the place that ``runs`` give to each ``row``; drop rows of no run."""
    begin = np.array([r[0] for r in runs], np.int64)
    end = np.array([r[1] for r in runs], np.int64)
    first = np.array([r[2] for r in runs], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            run = np.searchsorted(begin, row, side="right") - 1
            inside = (run >= 0) & (row < end[np.maximum(run, 0)])
            run = run[inside]
            kept = batch.filter(pa.array(inside))
            value = first[run] + row[inside] - begin[run]
            yield kept.append_column(into, pa.array(value, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    if not runs:
        return df.where(F.lit(False)).withColumn(into, F.lit(0).cast("long"))
    return df.mapInArrow(place, f"{schema}, {into} BIGINT")


def _histogram(df: DataFrame, column: str) -> dict[int, int]:
    """Collected: at most as many rows as a sequence has places."""
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def pack(pieces: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    ``pieces`` has ``doc_id``, ``piece``, ``length`` and any others. Only
    histograms reach the driver: of the lengths, and of the room left in the
    sequences, each with at most ``capacity`` rows whatever the data's size. The
    plan made of them is a list of rank intervals of the same order; ranks come
    from range-sorted prefix sums, so no task holds all pieces of a length.
    Repeated rows are packed as often as they come; no rows give no rows.
    """
    columns = pieces.columns
    ranked = ordered_prefixes(
        pieces, [F.desc("length"), "doc_id", "piece"], "length", "pieces"
    ).select(*columns, "row")
    histogram = _histogram(pieces, "length")
    runs, sequences = large_plan(histogram, capacity, groups)
    large = _by_runs(ranked, runs, "sequence_id")
    n_large = sum(n for length, n in histogram.items() if length > capacity // SMALL)

    filled = large.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("gap"))
    open_bins = ordered_prefixes(filled.where("gap > 0"), ["gap", "sequence_id"], "gap", "gaps")
    bins = materialise(open_bins.select("sequence_id", "gap", F.col("row").alias("bin")), "bins")
    small = {length: n for length, n in histogram.items() if length <= capacity // SMALL}
    gaps = _histogram(bins, "gap")
    fill, _ = small_plan(small, gaps, capacity)
    old = sum(gaps.values())
    placed = _by_runs(ranked, [(n_large + a, n_large + b, c) for a, b, c in fill], "bin")
    # a bin below ``old`` is a gap in a known sequence, others are new sequences
    into_gaps = placed.where(F.col("bin") < old).join(bins.select("bin", "sequence_id"), "bin")
    into_new = placed.where(F.col("bin") >= old).withColumn(
        "sequence_id", F.col("bin") - old + sequences
    )
    layout = [*columns, "sequence_id"]
    packed = large.select(layout).unionByName(into_gaps.select(layout))
    packed = packed.unionByName(into_new.select(layout))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return packed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def packed_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096
) -> DataFrame:
    """Pieces of whole documents with their sequences: the rows of the query.

    A null text is empty and gives the end id alone. Texts are read and encoded
    once; the pieces, a few numbers each, are written and then packed.
    """
    pieces = materialise(token_pieces(docs, vocabulary, end_id, capacity), "token-pieces")
    return pack(pieces, capacity)
