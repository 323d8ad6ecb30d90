import pytest
from pyspark.sql import functions as F
from tables import rows, seed_tables, table

from callsheet.operators import (
    breaking_rows,
    column_violations,
    coverage,
    duplicate_keys,
    integrity_report,
    orphans,
    rows_with_violations,
    uncovered,
)
from callsheet.schemas import FOREIGN_KEYS, TABLES


def test_duplicate_keys_hold_nulls_equal(spark):
    df = spark.createDataFrame(
        [(1, None), (1, None), (1, 2), (2, 2), (2, 2), (2, 2)], "a int, b int"
    )
    assert rows(duplicate_keys(df, ["a", "b"])) == [(1, None, 2), (2, 2, 3)]


def test_orphans_let_null_pass(spark):
    child = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(7,), (None,)], "id int")
    assert rows(orphans(child, "ref", parent, "id")) == [(2, 8)]


def test_null_and_length(spark):
    df = spark.createDataFrame(
        [(1, "ok"), (2, None), (None, "é" * 5), (4, "x" * 6)], "id int, text string"
    )
    found = column_violations(df, ["id", "text"], {"text": 5})
    assert rows(found) == [("id is null", 1), ("text is longer than 5", 1), ("text is null", 1)]
    bad = rows_with_violations(df, ["id", "text"], {"text": 5})
    assert rows(bad.select("id")) == [(2,), (4,), (None,)]


def test_unknown_check_passes(spark):
    edges = table(spark, "relation", [(1, 2), (3, 3), (None, 4)])
    bad = breaking_rows(edges, F.col("master_id") != F.col("apprentice_id"))
    assert rows(bad) == [(3, 3)]


def test_coverage_is_about_the_table_and_uncovered_about_entities(spark):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    spoken = spark.createDataFrame([(1,), (1,), (9,)], "entity_id int")
    assert rows(coverage(people, "id", spoken, "entity_id")) == [(2, True)]
    assert rows(coverage(people, "id", spoken.where("entity_id = 9"), "entity_id")) == [(0, False)]
    assert rows(uncovered(people, "id", spoken, "entity_id")) == [(2,)]


def test_integrity_of_the_whole_schema(derived):
    report = integrity_report(derived, TABLES, FOREIGN_KEYS)
    found = {(r.table_name, r.rule): r.violations for r in report.collect()}
    assert ("turn", "to_id has no entity") in found
    assert ("contest", "contest_id, part_id, first_id, second_id repeats") in found
    broken = {rule: n for rule, n in found.items() if n}
    # The invented lines hold one speaker's whole part, so most are too long.
    assert set(broken) == {("turn", "text is longer than 586")}


def test_integrity_finds_each_kind(spark):
    tables = seed_tables(spark)
    tables["relation"] = table(spark, "relation", [(1, 1), (77, 1)])
    tables["location"] = tables["location"].union(
        table(spark, "location", [(0, "location 0", 1, 1, None), (1, "x" * 21, 1, 1, None)])
    )
    tables["contest"] = table(spark, "contest", [(0, 0, 300, 1, 2, None)])
    report = integrity_report(tables, TABLES, FOREIGN_KEYS)
    found = {(r.table_name, r.rule): r.violations for r in report.collect()}
    assert found["relation", "ids_differ"] == 1
    assert found["relation", "master_id has no entity"] == 1
    assert found["location", "id repeats"] == 2
    assert found["location", "name repeats"] == 1
    assert found["location", "name is longer than 20"] == 1
    assert found["contest", "part_id_is_one_byte"] == 1
    assert found["contest", "part_id has no partition"] == 1


def test_a_report_on_nothing_is_an_error():
    with pytest.raises(ValueError, match="no rules"):
        integrity_report({}, {})
