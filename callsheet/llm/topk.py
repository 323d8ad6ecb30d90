"""Exact top-k inner products by Fagin's threshold algorithm, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.session import materialise

#: Rows and queries that meet in one group.
ROWS, QUERIES = 1 << 14, 1 << 9
#: Depth of the first round of sorted accesses; each next round doubles it.
FIRST_DEPTH = 64
RESULT = "query_row BIGINT, query_id BIGINT, row BIGINT, vec_id BIGINT, score BIGINT"


def whole_vectors(vectors: DataFrame, key: str, column: str, scale: int = 256) -> DataFrame:
    """``row`` (a number), ``vec_id`` and ``v``, each component floored after scaling
    in double. The numbers hold once the rows are written.

    Vectors that are null or hold a null, NaN or infinite component, and rows
    without a key, take no part. Rows with equal keys all do.
    """
    x = F.col(column)
    fit = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    found = vectors.where(F.col(key).isNotNull() & x.isNotNull()).where(fit)
    return found.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("vec_id"), whole.alias("v")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector counts as filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.asarray(lists.offsets)
    sizes = np.diff(ends)
    flat = np.asarray(lists.values)[ends[0] : ends[-1]]
    found = np.zeros((len(sizes), width), np.int64)
    found[np.repeat(np.arange(len(sizes)), sizes), _places(sizes)] = flat
    return found


def _places(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _best(ids: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows ``at`` (numbers in ``ids``), ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = scores >= kth
        at, scores = at[held], scores[held]
    order = np.lexsort((ids[at], -scores))[:k]
    return at[order], scores[order]


def threshold_search(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int, lists):
    """The k best rows for one query, but for its ``own`` (a row number, or -1):
    their numbers and scores, ties to the smaller id.

    ``lists`` are the row numbers and values sorted for each dimension. Each
    round reads the lists deeper, from the end that helps this query, and
    scores the rows it has not seen by random access. The values at the depth
    reached bound every row not seen yet; the search stops once the k-th score
    is above that bound (a tie goes on, as an unseen row may have a smaller id).
    """
    order, values = lists
    n = len(ids)
    seen = np.arange(n) == own
    used = np.flatnonzero(query)
    found, best = np.empty(0, np.int64), np.empty(0, rows.dtype)
    if not len(used):
        rest = np.flatnonzero(~seen)
        return _best(ids, rest, np.zeros(len(rest), rows.dtype), k)
    weight, from_top = query[used], query[used] > 0
    high, low = used[from_top], used[~from_top]
    at, depth = 0, FIRST_DEPTH
    while at < n:
        end = min(n, at + depth)
        met = np.zeros(n, bool)
        met[order[n - end : n - at, high]] = True
        met[order[at:end, low]] = True
        met &= ~seen
        seen |= met
        new = np.flatnonzero(met)
        if len(new):
            scores = rows[new] @ query
            found, best = _best(ids, np.r_[found, new], np.r_[best, scores], k)
        bound = (weight * np.where(from_top, values[n - end, used], values[end - 1, used])).sum()
        if len(best) == k and best[-1] > bound:
            break
        at, depth = end, depth * 2
    return found, best


def _search_group(k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in RESULT.split(", ")]
        found: dict[str, list] = {name: [] for name in names}
        if rows.num_rows and queries.num_rows:
            width = max(1, *(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (rows, queries)))
            ids, numbers = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
            matrix, asked = _matrix(rows.column("v"), width), _matrix(queries.column("v"), width)
            # sums of doubles are exact up to 2 ** 53; beyond it, Python's integers
            bound = float(np.abs(matrix).max()) * float(np.abs(asked).max()) * width
            kind = np.float64 if bound < 2**53 else object
            order = np.argsort(matrix, axis=0, kind="stable")
            matrix = matrix.astype(kind)
            lists = order.astype(np.int32), np.take_along_axis(matrix, order, 0)
            by_number = np.argsort(numbers)
            asking = zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)
            for (query_row, query_id), query in zip(asking, asked.astype(kind), strict=True):
                place = min(int(np.searchsorted(numbers, query_row, sorter=by_number)), len(ids) - 1)
                own = int(by_number[place]) if numbers[by_number[place]] == query_row else -1
                at, best = threshold_search(ids, matrix, query, own, k, lists)
                found["query_row"] += [query_row] * len(at)
                found["query_id"] += [query_id] * len(at)
                found["row"] += numbers[at].tolist()
                found["vec_id"] += ids[at].tolist()
                found["score"] += [int(s) for s in best]
        return pa.table({name: pa.array(found[name], pa.int64()) for name in names})

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """For each query row its k best other rows: ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score`` (integer inner product), ties to the smaller id.

    Rows and queries are dealt to blocks of bounded size by the hash of their
    numbers, and each block of rows meets each block of queries in a group of its
    own, where the threshold algorithm gives the block's k best. So the work is
    shared by many tasks, no side is broadcast, and k rows of each group remain
    for the final ranking, which keeps k rows per query before its shuffle.

    ``is_query`` is a condition on ``vec_id``. Rows with equal keys are all ranked,
    and each of them that is a query has its own ranks. Fewer other rows than k give all
    of them; shorter vectors count as filled with zeros; see ``whole_vectors``
    for rows that take no part; no rows give no rows.
    """
    clean = materialise(whole_vectors(vectors, key, column), "whole-vectors")
    queries = clean.where(is_query)
    n, asked = clean.count(), queries.count()
    row_blocks, query_blocks = -(-n // ROWS) or 1, -(-asked // QUERIES) or 1
    blocks = ["row_block", "query_block"]
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count))
    left = clean.withColumn("row_block", dealt(row_blocks, 1).cast("int")).withColumn(
        "query_block", every(query_blocks)
    )
    right = queries.withColumn("query_block", dealt(query_blocks, 2).cast("int")).withColumn(
        "row_block", every(row_blocks)
    )
    found = (
        left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(_search_group(k), RESULT)
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
