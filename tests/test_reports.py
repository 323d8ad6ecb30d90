"""Edge rows of each report: ties, NULLs, silence, missing rows."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tables import rows, table

from callsheet.plans import (
    average_share,
    best_group,
    extreme_share,
    flag_wins,
    nth_ranked,
    pair_totals,
    top_with_related,
)


def entities(spark, *found):
    """Entities from (id, name, score, flag_a, location_id)."""
    return table(spark, "entity", [(i, n, s, None, a, loc, None) for i, n, s, a, loc in found])


def named(spark, *ids):
    return entities(spark, *[(i, f"e{i}", 0, None, None) for i in ids])


def rollup(spark, *found):
    return spark.createDataFrame(list(found), "entity_id int, part_id short, words long")


def partitions(spark, *found):
    """Parts from (part_id, money, words_total)."""
    made = [(p, f"p{p}", date(2000, 1, 1 + i), 1, m, w, None) for i, (p, m, w) in enumerate(found)]
    return table(spark, "partition", made)


def relations(spark, *found):
    return table(spark, "relation", list(found))


# --- top with related ---


def test_top_keeps_ties_and_drops_entities_without_relation(spark):
    spoken = rollup(spark, (1, 4, 9), (2, 4, 9), (3, 4, 8), (3, 5, 7), (1, 5, None), (1, 6, None))
    top = top_with_related(spoken, relations(spark, (3, 1), (3, 2)), named(spark, 1, 2, 3))
    assert rows(top) == [(4, 1, "e1", 9, " e3"), (4, 2, "e2", 9, " e3")]


def test_top_related_names(spark):
    spoken = rollup(spark, (1, 4, 9), (2, 5, 9), (3, 6, 9), (4, 7, 9))
    edges = relations(spark, (3, 1), (2, 1), (2, 1), (99, 1), (99, 2), (None, 3), (1, 4))
    people = named(spark, 1, 2, 3)  # 4 is unknown, 99 has no name
    top = top_with_related(spoken, edges, people, partitions(spark, (4, 1, 1)))
    assert rows(top) == [
        (4, "p4", 1, "e1", 9, " e2, e2, e3"),
        (5, None, 2, "e2", 9, None),
    ]
    clean = top_with_related(spoken, edges, people, leading_blank=False)
    assert rows(clean)[0] == (4, 1, "e1", 9, "e2, e2, e3")


# --- best group ---


def test_best_group_cuts_the_average_and_breaks_ties_by_id(spark):
    people = entities(
        spark,
        (1, "a", 7, None, 2),
        (2, "b", 8, None, 2),
        (3, "c", 7, None, 1),
        (4, "d", None, None, 1),
        (5, "best", 99, None, None),
        (6, "lost", 98, None, 50),
    )
    places = table(spark, "location", [(i, f"l{i}", 1, 1, None) for i in (1, 2, 3)])
    assert rows(best_group(people, places)) == [(1, "l1", 7, 2, "best")]
    assert rows(best_group(people)) == [(50, 98, 1, "best")]


def test_best_group_average_is_cut_toward_zero_and_null_is_last(spark):
    people = entities(
        spark, (1, "a", -3, None, 1), (2, "b", -4, None, 1), (3, "c", None, None, 0)
    )
    assert rows(best_group(people)) == [(1, -3, 2, "a")]
    unknown = entities(spark, (3, "c", None, None, 0))
    assert rows(best_group(unknown)) == [(0, None, 1, "c")]


# --- shares ---


def test_average_share_counts_silent_parts_and_entities(spark):
    parts = partitions(spark, (4, 1000, 10), (5, 500, 10), (6, 77, 3))
    spoken = rollup(spark, (1, 4, 5), (1, 5, 1), (2, 5, None), (9, 4, 1), (1, 8, 4))
    shares = average_share(named(spark, 1, 2, 3), spoken, parts)
    assert rows(shares) == [
        (1, "e1", Decimal("183.333333")),
        (2, "e2", Decimal("0.000000")),
        (3, "e3", Decimal("0.000000")),
    ]


def test_a_zero_total_is_an_error_even_where_nobody_spoke(spark):
    parts = partitions(spark, (4, 1000, 10), (5, 500, 0))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        average_share(named(spark, 1), rollup(spark, (1, 4, 5)), parts).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        extreme_share(rollup(spark, (1, 5, 5)), parts, named(spark, 1)).collect()


def test_extreme_share_modes_ties_and_nulls(spark):
    parts = partitions(spark, (4, 10_000_000, 10), (5, 10_000_000, 20), (7, 1, 1))
    spoken = rollup(
        spark, (2, 4, 5), (1, 4, 5), (3, 4, 1), (1, 5, None), (2, 5, 3), (3, 5, 3), (1, 6, 9)
    )
    people = named(spark, 1, 2, 3)
    most = extreme_share(spoken, parts, people, "Most")
    assert rows(most) == [
        (4, "p4", 1, "e1", Decimal("5.000000")),
        (5, "p5", 2, "e2", Decimal("1.500000")),
    ]
    least = extreme_share(spoken, parts, people, "LEAST")
    assert rows(least) == [
        (4, "p4", 3, "e3", Decimal("1.000000")),
        (5, "p5", 1, "e1", None),
    ]
    without_winner = extreme_share(spoken, parts, named(spark, 2, 3), "most")
    assert [r[0] for r in rows(without_winner)] == [5]
    with pytest.raises(ValueError, match="mode"):
        extreme_share(spoken, parts, people, "best")


# --- pairs ---


def turns(spark, *found):
    """Turns from (id, from_id, to_id, text, word_count)."""
    return table(spark, "turn", [(i, 4, f, t, text, n) for i, f, t, text, n in found])


def test_pair_totals(spark):
    said = turns(
        spark,
        (0, 1, 2, "short", 3),
        (1, 2, 1, "long, later", 5),
        (2, 1, 2, "long, latest", 5),
        (3, 3, 3, "self", 2),
        (4, 1, None, "to nobody", 50),
        (5, 103, 10, "wide ids", 7),
        (6, 11, 3, "other wide ids", 4),
        (7, 4, 1, "unknown", None),
        (8, 1, 4, "known", 1),
        (9, 5, 1, "all unknown", None),
    )
    plain = pair_totals(said)
    assert rows(plain) == [
        (2, 1, 13, "long, later"),
        (3, 3, 2, "self"),
        (4, 1, 1, "known"),
        (5, 1, None, "all unknown"),
        (11, 3, 4, "other wide ids"),
        (103, 10, 7, "wide ids"),
    ]
    with_names = pair_totals(said, named(spark, 1, 2, 10, 103))
    assert rows(with_names) == [
        (2, 1, "e2", "e1", 13, "long, later"),
        (103, 10, "e103", "e10", 7, "wide ids"),
    ]
    assert rows(pair_totals(said, text=None))[0] == (2, 1, 13, 1)


def test_pair_totals_with_a_key_of_several_columns(spark):
    said = turns(spark, (0, 1, 2, "a", 5), (0, 1, 2, "b", 5), (1, 3, 3, "c", 1))
    keyed = said.withColumn("line", F.when(F.col("text") == "a", 2).otherwise(1))
    assert rows(pair_totals(keyed, turn=("id", "line"))) == [(2, 1, 10, "b"), (3, 3, 1, "c")]
    with pytest.raises(Exception, match="a turn id has several texts"):
        pair_totals(said).collect()


# --- flags ---


def contests(spark, *found):
    return table(spark, "contest", [(i, i, 4, f, s, won) for i, (f, s, won) in enumerate(found)])


def test_flag_wins(spark):
    people = entities(
        spark, (1, "a", 0, True, None), (2, "b", 0, False, None), (3, "c", 0, None, None)
    )
    fought = contests(
        spark, (1, 2, True), (1, 2, True), (1, 2, False), (2, 1, None), (1, 3, True), (1, 1, True)
    )
    assert rows(flag_wins(fought, people, "flag_a")) == [(True, 3)]
    assert rows(flag_wins(fought, people, "flag_a", winner_aware=True)) == [(False, 1), (True, 2)]


# --- n-th ranked ---


def test_nth_ranked(spark):
    people = entities(
        spark,
        (1, "a", 5, None, None),
        (2, "b", 9, None, None),
        (3, "c", 5, None, None),
        (4, "d", None, None, None),
        (5, "e", 10, None, None),
    )
    spoken = rollup(spark, (1, 4, 1), (2, 4, 2), (3, 4, 3), (4, 4, 4), (5, 5, 5), (9, 4, 6))
    order = [nth_ranked(people, spoken, 4, n).collect() for n in range(0, 6)]
    assert [[r.id for r in found] for found in order] == [[], [2], [1], [3], [4], []]
    assert order[2][0].asDict()["rank"] == 2
    assert order[2][0].words == 1
    assert nth_ranked(people, spoken, 4, None).collect() == []
    assert nth_ranked(people, spoken, 4, 1).columns == [
        *people.columns, "entity_id", "part_id", "words", "rank",
    ]
