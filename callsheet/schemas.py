"""The eight tables: types, keys, defaults, checks and foreign keys.

Parquet enforces none of these rules; ``operators.quality`` checks them as jobs
and ``operators.deletes`` applies the delete actions. One-byte unsigned part
numbers are held as ``short`` with a range check, as Spark's ``byte`` is signed.
Types, lengths, keys, defaults and delete actions are fixed values: results that
should equal the original's need them as they are.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

CASCADE = "cascade"
SET_NULL = "set_null"
REFUSE = "refuse"

INT, LONG, SHORT = IntegerType(), LongType(), ShortType()
TEXT, DATE, FLAG = StringType(), DateType(), BooleanType()


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.key``."""

    child: str
    column: str
    parent: str
    key: str
    on_delete: str = REFUSE


@dataclass(frozen=True)
class TableRules:
    """A table's schema and the rules its rows must keep.

    NOT NULL columns are the schema's non-nullable ones. A check is a SQL
    predicate; a row breaks it only if it is false, not if it is unknown.
    """

    schema: StructType
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    max_length: Mapping[str, int] = field(default_factory=dict)
    defaults: Mapping[str, Any] = field(default_factory=dict)
    checks: Mapping[str, str] = field(default_factory=dict)

    @property
    def not_null(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def _schema(**columns: tuple[DataType, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, (t, nullable) in columns.items()])


def _required(kind: DataType) -> tuple[DataType, bool]:
    return kind, False


def _optional(kind: DataType) -> tuple[DataType, bool]:
    return kind, True


_PART_RANGE = {"part_id_is_one_byte": "part_id BETWEEN 0 AND 255"}

TABLES: dict[str, TableRules] = {
    "partition": TableRules(
        _schema(
            part_id=_required(SHORT),
            name=_required(TEXT),
            release_date=_required(DATE),
            budget=_required(LONG),
            money=_required(LONG),
            words_total=_required(INT),
            words_known=_optional(LONG),
        ),
        primary_key=("part_id",),
        unique=(("name",), ("release_date",)),
        max_length={"name": 50},
        checks=_PART_RANGE,
    ),
    "location": TableRules(
        _schema(
            id=_required(INT),
            name=_required(TEXT),
            suns=_optional(INT),
            moons=_optional(INT),
            population=_optional(LONG),
        ),
        primary_key=("id",),
        unique=(("name",),),
        max_length={"name": 20},
        defaults={"suns": 1, "moons": 1},
    ),
    "entity": TableRules(
        _schema(
            id=_required(INT),
            name=_required(TEXT),
            score=_optional(INT),
            actor=_optional(TEXT),
            flag_a=_optional(FLAG),
            location_id=_optional(INT),
            flag_b=_optional(FLAG),
        ),
        primary_key=("id",),
        unique=(("name",),),
        max_length={"name": 50, "actor": 50},
        defaults={"score": 0, "flag_b": None},
    ),
    "turn": TableRules(
        _schema(
            id=_required(INT),
            part_id=_required(SHORT),
            from_id=_required(INT),
            to_id=_optional(INT),
            text=_required(TEXT),
            word_count=_optional(LONG),
        ),
        primary_key=("id",),
        max_length={"text": 586},
        checks=_PART_RANGE,
    ),
    "rollup": TableRules(
        _schema(
            relation_id=_required(LONG),
            entity_id=_required(INT),
            part_id=_required(SHORT),
            words=_optional(LONG),
        ),
        primary_key=("relation_id",),
        unique=(("entity_id", "part_id"),),
        checks=_PART_RANGE,
    ),
    "pair": TableRules(
        _schema(from_id=_required(INT), to_id=_optional(INT), words=_required(LONG)),
        unique=(("from_id", "to_id"),),
    ),
    "relation": TableRules(
        _schema(master_id=_optional(INT), apprentice_id=_optional(INT)),
        checks={"ids_differ": "master_id <> apprentice_id"},
    ),
    "contest": TableRules(
        _schema(
            id=_required(INT),
            contest_id=_required(INT),
            part_id=_required(SHORT),
            first_id=_required(INT),
            second_id=_required(INT),
            outcome=_optional(FLAG),
        ),
        primary_key=("id",),
        unique=(("contest_id", "part_id", "first_id", "second_id"),),
        checks=_PART_RANGE,
    ),
}

FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("entity", "location_id", "location", "id", SET_NULL),
    ForeignKey("rollup", "entity_id", "entity", "id", CASCADE),
    ForeignKey("rollup", "part_id", "partition", "part_id", CASCADE),
    ForeignKey("turn", "part_id", "partition", "part_id", CASCADE),
    ForeignKey("turn", "from_id", "entity", "id", CASCADE),
    ForeignKey("turn", "to_id", "entity", "id", REFUSE),
    ForeignKey("pair", "from_id", "entity", "id", CASCADE),
    ForeignKey("pair", "to_id", "entity", "id", REFUSE),
    ForeignKey("relation", "master_id", "entity", "id", REFUSE),
    ForeignKey("relation", "apprentice_id", "entity", "id", REFUSE),
    ForeignKey("contest", "part_id", "partition", "part_id", CASCADE),
    ForeignKey("contest", "first_id", "entity", "id", CASCADE),
    ForeignKey("contest", "second_id", "entity", "id", REFUSE),
)
