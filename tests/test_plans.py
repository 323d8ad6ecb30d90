"""What the physical plans must, and must not, hold."""

import re

import pytest

import __spark_entry__ as registered
import callsheet.plans.reports as reports
import callsheet.plans.workload as workload
from callsheet.operators import bitmaps, deletes, keys, ranking

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def whole_plans(monkeypatch):
    """Leave intermediates unwritten, so that a plan shows all of its query."""
    for module in (registered, reports, deletes, workload, bitmaps):
        monkeypatch.setattr(module, "materialise", lambda df, label: df)


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


OWN = [n for n in registered.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.mark.parametrize("name", sorted(OWN))
def test_no_python_and_no_cross_join(spark, whole_plans, name):
    text = plan(registered.queries()[name](spark, SF_DIR))
    for bad in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", ["most_share", "least_share", "most_words"])
def test_ranking_keeps_one_row_per_part_before_the_shuffle(spark, whole_plans, name):
    text = plan(registered.queries()[name](spark, SF_DIR))
    assert "row_number(), 1, Partial" in text


def test_first_rows_need_no_global_sort(spark, whole_plans):
    assert "TakeOrderedAndProject" in plan(registered.queries()["best_group"](spark, SF_DIR))


def test_a_rank_is_found_without_a_range_sort_or_a_write(spark, monkeypatch):
    def refuse(df, label):
        raise AssertionError(f"{label} is written")

    for module in (ranking, reports, keys):
        monkeypatch.setattr(module, "materialise", refuse, raising=False)
    for name in ("nth_ranked", "nth_ranked_late", "nth_line", "nth_line_late"):
        monkeypatch.setattr(ranking, "FEW", 1 << 40)
        text = plan(registered.queries()[name](spark, SF_DIR))
        assert "rangepartitioning" not in text and "Window" not in text


def test_a_rank_behind_the_last_is_looked_for_in_the_tables(spark, monkeypatch):
    read = []
    splitters = ranking._splitters
    monkeypatch.setattr(ranking, "_splitters", lambda df, order: read.append(plan(df)) or splitters(df, order))
    assert registered.queries()["nth_ranked_empty"](spark, SF_DIR).count() == 0
    assert read and read[0].count("Scan parquet") >= 2


def test_each_report_writes_only_what_it_needs(spark, monkeypatch):
    written = []

    def keep(df, label):
        written.append(label)
        return df

    monkeypatch.setattr(workload, "materialise", keep)
    monkeypatch.setattr(keys, "materialise", keep)
    wanted = {
        "best_group": [],
        "flag_a_wins": [],
        "flag_b_wins": [],
        "pair_totals": ["words"],
        "average_share": ["rollup-words", "parts"],
        "most_share": ["rollup-words", "parts"],
    }
    for name, labels in wanted.items():
        written.clear()
        registered.queries()[f"workload_{name}"](spark, SF_DIR)
        assert sorted(written) == sorted(labels), name


def test_row_rules_are_counted_apart_from_the_keys(spark, whole_plans):
    text = plan(registered.queries()["integrity_report"](spark, SF_DIR)).split("\n\n")
    scans = [n for n in text if n.startswith("(") and "Scan parquet" in n.split("\n")[0]]
    of = {t: sum(f"{SF_DIR}/{t}.parquet" in n for n in scans) for t in ("lineitem", "documents")}
    assert of == {"lineitem": 3, "documents": 2}
    # what is shuffled for a key rule are the keys
    folds = [n for n in text if "Keys [2]: [l_orderkey" in n and "partial_count" in n]
    assert folds and all("count_if" not in n for n in folds)


def test_the_related_names_read_each_table_once_beside_the_fold(spark, whole_plans):
    text = plan(registered.queries()["top_with_related"](spark, SF_DIR)).split("\n\n")[0]
    assert text.count("HashAggregate") >= 4


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(registered.table_scan(spark, SF_DIR))
    assert "EqualTo(l_returnflag,R)" in text
    expected = "struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_returnflag:string>"
    assert expected in text


def test_part_filter_reaches_the_scan_through_the_rollup(spark, whole_plans):
    text = plan(registered.queries()["nth_ranked"](spark, SF_DIR))
    assert "EqualTo(o_orderpriority,5-LOW)" in text


def test_pair_totals_hash_numbers_only(spark, whole_plans):
    """The fold over all turns is a hash aggregate, and no text goes through it."""
    turns = registered._flow(spark, SF_DIR).withColumnRenamed("l_returnflag", "text")
    text = plan(reports.pair_totals(turns, words="qty", turn="l_orderkey")).split("\n\n")
    folds = [node for node in text if "partial_sum(qty" in node]
    assert folds and all("HashAggregate" in node and "text" not in node for node in folds)


def test_known_small_tables_are_broadcast_and_large_ones_are_not(spark):
    """Broadcasts follow the measured size, whichever table it is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastHashJoin" not in plan(registered.queries()["flag_wins"](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan(registered.queries()["flag_wins"](spark, SF_DIR))


def test_bitmaps_take_the_place_of_rows_in_the_shuffle(spark, whole_plans):
    nodes = plan(registered.queries()["orphan_keys"](spark, SF_DIR)).split("\n\n")
    shuffled = [n for n in nodes if "Exchange" in n.split("\n")[0]]
    assert shuffled and all("hashpartitioning(bucket" in n for n in shuffled if "hashpartitioning" in n)
