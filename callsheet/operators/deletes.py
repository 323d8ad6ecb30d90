"""Deleting parents: cascade, set-null or refuse, along the foreign keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.schemas import CASCADE, REFUSE, SET_NULL, ForeignKey
from callsheet.session import materialise


class DeleteRefused(ValueError):
    """Rows that stay still refer to a deleted parent."""


def delete_rows(
    tables: Mapping[str, DataFrame],
    foreign_keys: Iterable[ForeignKey],
    table: str,
    condition: Column,
) -> dict[str, DataFrame]:
    """The tables after deleting the rows of ``table`` that meet ``condition``.

    Cascading references lose their rows, level by level, until a level has no
    key left, so references in a circle end as well; set-null references lose
    the value. After that no remaining row may refer to a deleted one over a
    refusing reference; :func:`refusals` lists those that do.

    The deleted keys are written first, so that each child's join is planned
    with their true size; the tables themselves are not written.
    """
    after, lost = _cascaded(tables, foreign_keys, table, condition)
    for fk, blocking in _blocking(after, lost):
        if not blocking.isEmpty():
            raise DeleteRefused(f"{fk.child}.{fk.column} still refers to {fk.parent}")
    for fk, keys in lost:
        if fk.on_delete == SET_NULL:
            after[fk.child] = _without_reference(after[fk.child], fk.column, keys)
    return after


def refusals(
    tables: Mapping[str, DataFrame],
    foreign_keys: Iterable[ForeignKey],
    table: str,
    condition: Column,
) -> dict[str, DataFrame]:
    """Per child table the rows that would stay and refer to a deleted one over a
    refusing reference: those that make :func:`delete_rows` refuse. Tables
    without such a reference to deleted rows are not named."""
    after, lost = _cascaded(tables, foreign_keys, table, condition)
    found: dict[str, DataFrame] = {}
    for fk, blocking in _blocking(after, lost):
        found[fk.child] = found[fk.child].union(blocking) if fk.child in found else blocking
    return found


def _cascaded(
    tables: Mapping[str, DataFrame],
    foreign_keys: Iterable[ForeignKey],
    table: str,
    condition: Column,
) -> tuple[dict[str, DataFrame], list[tuple[ForeignKey, DataFrame]]]:
    links = list(foreign_keys)
    after = dict(tables)
    after[table] = tables[table].where(~F.coalesce(condition, F.lit(False)))
    lost: list[tuple[ForeignKey, DataFrame]] = []
    pending = [(table, tables[table].where(condition))]
    while pending:
        name, rows = pending.pop()
        for fk in links:
            if fk.parent == name and fk.child in after:
                keys = materialise(rows.select(F.col(fk.key).alias("_gone")).distinct(), "gone")
                if keys.isEmpty():
                    continue
                lost.append((fk, keys))
                if fk.on_delete == CASCADE:
                    # rows already deleted are not in it, so every level is new
                    before = after[fk.child]
                    after[fk.child] = _matching(before, fk.column, keys, "left_anti")
                    pending.append((fk.child, _matching(before, fk.column, keys, "left_semi")))
    return after, lost


def _blocking(after: Mapping[str, DataFrame], lost: list[tuple[ForeignKey, DataFrame]]):
    for fk, keys in lost:
        if fk.on_delete == REFUSE:
            yield fk, _matching(after[fk.child], fk.column, keys, "left_semi")


def _matching(df: DataFrame, column: str, keys: DataFrame, how: str) -> DataFrame:
    return df.join(keys, F.col(column) == F.col("_gone"), how)


def _without_reference(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    joined = df.join(keys, F.col(column) == F.col("_gone"), "left")
    return joined.withColumn(column, kept).select(*df.columns)
