"""Table rules as jobs that return the rows, or the counts, that break them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from callsheet.schemas import ForeignKey, TableRules


#: How the original tables compare text: without case, and without trailing blanks.
SOURCE_COLLATION = "UNICODE_CI_RTRIM"


def _collated(df: DataFrame, name: str, collation: str | None) -> Column:
    """A column as it is compared: text by the collation, all else as it is."""
    if collation is not None and isinstance(df.schema[name].dataType, StringType):
        return F.collate(F.col(name), collation)
    return F.col(name)


def duplicate_keys(
    df: DataFrame, keys: Sequence[str], into: str = "copies", collation: str | None = None
) -> DataFrame:
    """Keys held by more than one row; NULLs count as equal.

    With a ``collation``, texts that it holds equal are one key, of which the least
    spelling is shown.
    """
    if collation is None:
        return df.groupBy(*keys).agg(F.count("*").alias(into)).where(F.col(into) > 1)
    compared = [_collated(df, k, collation).alias(f"_{i}") for i, k in enumerate(keys)]
    shown = [F.min(k).alias(k) for k in keys]
    found = df.groupBy(*compared).agg(*shown, F.count("*").alias(into))
    return found.where(F.col(into) > 1).select(*keys, into)


def orphans(
    child: DataFrame, column: str, parent: DataFrame, key: str, collation: str | None = None
) -> DataFrame:
    """Child rows whose reference meets no parent; a NULL reference is legal. With a
    ``collation`` a text meets the parents that it holds equal."""
    parents = parent.select(_collated(parent, key, collation).alias("_parent_key"))
    return child.where(F.col(column).isNotNull()).join(
        parents, _collated(child, column, collation) == F.col("_parent_key"), "left_anti"
    )


def _column_rules(not_null: Iterable[str], max_length: Mapping[str, int]) -> dict[str, Column]:
    rules = {f"{name} is null": F.col(name).isNull() for name in not_null}
    for name, limit in max_length.items():
        rules[f"{name} is longer than {limit}"] = F.length(name) > limit
    return rules


def _row_rules(rules: TableRules) -> dict[str, Column]:
    breaks = _column_rules(rules.not_null, rules.max_length)
    breaks.update({name: ~F.expr(check) for name, check in rules.checks.items()})
    return breaks


def _rule_counts(df: DataFrame, breaks: Mapping[str, Column]) -> DataFrame:
    """One row per rule with its number of breaking rows, from one pass."""
    broken = enumerate(breaks.values())
    counts = df.agg(*[F.count_if(rule).alias(f"_{i}") for i, rule in broken])
    rows = [
        F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, rule in enumerate(breaks)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _repeats(keys: Sequence[str]) -> str:
    return f"{', '.join(keys)} repeats"


def column_violations(
    df: DataFrame, not_null: Iterable[str] = (), max_length: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows per broken NOT NULL or length rule: ``rule, violations``."""
    return _rule_counts(df, _column_rules(not_null, max_length or {}))


def rows_with_violations(
    df: DataFrame, not_null: Iterable[str] = (), max_length: Mapping[str, int] | None = None
) -> DataFrame:
    """The rows that break at least one NOT NULL or length rule."""
    breaks = _column_rules(not_null, max_length or {}).values()
    return df.where(reduce(lambda a, b: a | b, breaks, F.lit(False)))


def breaking_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the check is false; an unknown check passes."""
    return df.where(~predicate)


def coverage(
    entities: DataFrame, key: str, rollup: DataFrame, rollup_key: str, into: str = "matches"
) -> DataFrame:
    """One row: the number of rollup rows that meet an entity, and whether any does.

    This is the declared expectation. It says nothing about single entities;
    :func:`uncovered` does. Rollup rows are counted per key before the join.
    """
    ids = entities.select(F.col(key).alias("_entity_key"))
    counts = rollup.groupBy(F.col(rollup_key).alias("_seen_key")).agg(F.count("*").alias("_rows"))
    met = counts.join(ids, F.col("_seen_key") == F.col("_entity_key"))
    matches = F.coalesce(F.sum("_rows"), F.lit(0).cast("long"))
    return met.agg(matches.alias(into)).withColumn("holds", F.col(into) != 0)


def uncovered(entities: DataFrame, key: str, rollup: DataFrame, rollup_key: str) -> DataFrame:
    """Entities without any rollup row.

    The right side of an anti join cannot be split by the planner, so a key
    with very many rollup rows is reduced to one before it.
    """
    seen = rollup.select(F.col(rollup_key).alias("_seen_key")).distinct()
    return entities.join(seen, F.col(key) == F.col("_seen_key"), "left_anti")


def integrity_report(
    tables: Mapping[str, DataFrame],
    rules: Mapping[str, TableRules],
    foreign_keys: Iterable[ForeignKey] = (),
) -> DataFrame:
    """Every declared rule of the given tables: ``table_name, rule, violations``.

    A table's row rules are counted together, each task sending one row of counts.
    A key rule counts the keys held twice, and shuffles the key columns only. A
    reference rule counts the orphan rows, folded per value before the join.
    Without any rule for the given tables there is nothing to report, which is an
    error.
    """
    reports = []
    for name in [n for n in tables if n in rules]:
        rule_set, df = rules[name], tables[name]
        breaks = _row_rules(rule_set)
        if breaks:
            reports.append(_rule_counts(df, breaks).withColumn("table_name", F.lit(name)))
        for keys in [k for k in (rule_set.primary_key, *rule_set.unique) if k]:
            found = duplicate_keys(df, keys)
            reports.append(_count_of(found, name, _repeats(keys), F.count("*")))
    for fk in foreign_keys:
        if fk.child in tables and fk.parent in tables:
            values = tables[fk.child].groupBy(fk.column).agg(F.count("*").alias("_rows"))
            lost = orphans(values, fk.column, tables[fk.parent], fk.key)
            rule = f"{fk.column} has no {fk.parent}"
            reports.append(_count_of(lost, fk.child, rule, F.sum("_rows")))
    if not reports:
        raise ValueError("the given tables have no rules")
    columns = ("table_name", "rule", "violations")
    return reduce(DataFrame.unionByName, [r.select(*columns) for r in reports])


def _count_of(found: DataFrame, table: str, rule: str, rows: Column) -> DataFrame:
    return found.agg(F.coalesce(rows, F.lit(0).cast("long")).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"
    )
