"""The n-th row of an order, found by counting instead of sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.session import materialise

#: A column and whether it descends; NULLs come last either way.
Order = Sequence[tuple[str, bool]]

#: Rows of the sample that the ranges are taken from, and its places between ranges.
SAMPLE, SPLITTERS = 1024, 63
#: Rows that are sorted in the end, at most.
FEW = 20_000


def nth_row(df: DataFrame, order: Order, n: int | None) -> DataFrame:
    """The row at place ``n`` (from 1) of ``df`` in the given order, or no row.

    Each round takes 63 splitters from a random sample of 1,024 rows, counts the
    rows in the ranges between them, and keeps the range that holds the place. So
    a round leaves about a 64th; it is a scan whose result is at most 127 counts.
    Once 20,000 rows or fewer are left, they are ordered, in a bounded heap. The
    rows are never sorted by range. What a second round reads is written, about a
    64th of the rows.

    A row that equals a splitter in the order's columns is counted apart, so that
    many equal rows end the search instead of staying in one range; equal rows are
    interchangeable, any of them is returned. A place before the first, behind the
    last or NULL gives no row. The columns of the order may have any type that
    Spark can sort and Python can hold.
    """
    if n is None or n < 1:
        return df.limit(0)
    rest, now, size = n, df, None
    while size is None or size > FEW:
        splitters = _splitters(now, order)
        place = _range_of(now, order, splitters)
        counts = {r["at"]: r["count"] for r in now.groupBy(place.alias("at")).count().collect()}
        for at in sorted(counts):
            if rest <= counts[at]:
                break
            rest -= counts[at]
        else:
            return df.limit(0)
        now, size = now.where(_in_range(now, order, splitters, at)), counts[at]
        if at % 2:  # all of them equal a splitter
            return now.limit(1)
        if size > FEW:
            now = materialise(now, "rank-range")
    # of the first `rest` rows the last
    return now.orderBy(*_sorting(order)).limit(rest).orderBy(*_sorting(order, back=True)).limit(1)


def _sorting(order: Order, back: bool = False) -> list[Column]:
    if back:
        return [F.col(c).asc_nulls_first() if down else F.col(c).desc_nulls_first() for c, down in order]
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def _splitters(df: DataFrame, order: Order) -> list[tuple]:
    """Distinct rows of a sample at even distances, in the given order."""
    columns = [c for c, _ in order]
    sample = df.select(*columns).orderBy(F.rand()).limit(SAMPLE)
    rows = [tuple(r) for r in sample.orderBy(*_sorting(order)).collect()]
    step = max(1, len(rows) // (SPLITTERS + 1))
    picked = rows[step - 1 :: step][:SPLITTERS]
    return [row for i, row in enumerate(picked) if not i or row != picked[i - 1]]


def _range_of(df: DataFrame, order: Order, splitters: Sequence[tuple]) -> Column:
    """2 i for a row between splitters i - 1 and i, 2 i + 1 for one that equals splitter i.

    A search by halves in arrays of the splitters: a row is compared six times, and
    the expression is as short for 63 splitters as for one.
    """
    if not splitters:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c, _ in order]
    arrays = [
        F.array(*[F.lit(v).cast(kind) for v in values])
        for values, kind in zip(zip(*splitters, strict=True), kinds, strict=True)
    ]

    def at(place: Column) -> list[Column]:
        return [F.get(array, place) for array in arrays]

    def halve(found: Column, step: Column) -> Column:
        later, equal = _against(order, at(found + step - 1))
        return F.when((found + step <= len(splitters)) & (later | equal), found + step).otherwise(found)

    halves = [F.lit(1 << i) for i in reversed(range(len(splitters).bit_length()))]
    # splitters up to the row, equal ones included; a row of NULLs comes behind them all
    found = F.aggregate(F.array(*halves), F.lit(0), halve)
    return F.transform(F.array(found), lambda f: 2 * f - _against(order, at(f - 1))[1].cast("int"))[0]


def _in_range(df: DataFrame, order: Order, splitters: Sequence[tuple], place: int) -> Column:
    """Whether a row is in that range: against the one or two splitters beside it."""
    kinds = [df.schema[c].dataType for c, _ in order]

    def against(i: int) -> tuple[Column, Column]:
        return _against(order, [F.lit(v).cast(kind) for v, kind in zip(splitters[i], kinds, strict=True)])

    i = place // 2
    if place % 2:
        return against(i)[1]
    inside = F.lit(True)
    if i > 0:
        inside = against(i - 1)[0]
    if i < len(splitters):
        later, equal = against(i)
        inside = inside & ~(later | equal)
    return inside


def _against(order: Order, values: Sequence[Column]) -> tuple[Column, Column]:
    """Whether a row comes later than the one of these values, and whether it equals it."""
    later, equal = F.lit(False), F.lit(True)
    for (name, down), value in reversed(list(zip(order, values, strict=True))):
        column = F.col(name)
        behind = value.isNotNull() & (column.isNull() | ((column < value) if down else (column > value)))
        same = column.eqNullSafe(value)
        later, equal = behind | (same & later), same & equal
    return later, equal
