"""The expected results of the nine reports on the seed values."""

import pytest
from tables import rows, seed_tables

from callsheet.plans import all_reports, create_views, derive, live_views, nth_ranked


@pytest.fixture(scope="module")
def found(derived):
    return all_reports(derived, nth_part=4, nth=2)


def test_derived_tables(derived):
    parts = {r.part_id: r.words_known for r in derived["partition"].collect()}
    assert parts == {4: 3385, 5: 4546, 6: 5664}
    rollup = derived["rollup"].collect()
    assert len(rollup) == 23
    assert sorted(r.relation_id for r in rollup) == list(range(23))
    assert sum(r.words for r in rollup) == 13595
    assert sum(r.words for r in derived["pair"].collect()) == 13595


def test_top_with_related(found):
    assert rows(found["top_with_related"]) == [
        (4, "part 4", 0, "entity 0", 1085, " entity 4"),
        (5, "part 5", 2, "entity 2", 1365, " entity 0, entity 1, entity 3"),
        (6, "part 6", 2, "entity 2", 1680, " entity 0, entity 1, entity 3"),
    ]


def test_best_group(found):
    assert rows(found["best_group"]) == [(2, "location 2", 27700, 1, "entity 2")]


def test_average_share(found):
    shares = [(r.entity_id, float(r.worth_in_millions)) for r in found["average_share"].collect()]
    expected = [
        (2, 127.0008), (3, 91.7174), (1, 71.4313), (6, 63.3386), (0, 40.6736),
        (7, 34.8870), (8, 28.2341), (4, 13.2781), (9, 3.8897), (5, 1.2371),
    ]
    assert [e for e, _ in shares] == [e for e, _ in expected]
    assert [s for _, s in shares] == pytest.approx([s for _, s in expected], abs=1e-4)


@pytest.mark.parametrize(
    ("report", "expected"),
    [
        ("most_share", {4: (0, 122.020915), 5: (2, 111.683373), 6: (2, 200.042781)}),
        ("least_share", {4: (5, 3.711235), 5: (1, 20.454830), 6: (4, 5.715508)}),
    ],
)
def test_extreme_share(found, report, expected):
    shares = {
        r.part_id: (r.entity_id, float(r.worth_in_millions)) for r in found[report].collect()
    }
    assert {p: e for p, (e, _) in shares.items()} == {p: e for p, (e, _) in expected.items()}
    for part, (_, worth) in expected.items():
        assert shares[part][1] == pytest.approx(worth, abs=1e-6)


def test_flag_wins(found):
    assert rows(found["flag_a_wins"]) == [(False, 2), (True, 3)]
    assert rows(found["flag_b_wins"]) == [(False, 5), (True, 2)]


def test_nth_ranked(found, derived):
    row = found["nth_ranked"].first()
    assert (row.id, row.words, row["rank"]) == (1, 344, 2)
    order = [nth_ranked(derived["entity"], derived["rollup"], 4, n) for n in range(1, 10)]
    assert [[r.id for r in df.collect()] for df in order] == [
        [2], [1], [7], [3], [5], [8], [0], [6], [],
    ]


def test_sql_users_get_views_and_function(spark, derived, found):
    create_views(derived, found)
    top = spark.sql("SELECT entity_id FROM report_top_with_related WHERE part_id = 4")
    assert rows(top) == [(0,)]
    words = spark.sql(
        "SELECT sum(word_count(text)) FROM turn WHERE part_id = :part", args={"part": 6}
    )
    assert rows(words) == [(5664,)]


def test_a_second_derivation_gives_the_same(spark, derived):
    again = derive(seed_tables(spark))
    for name in ("turn", "rollup", "pair", "partition"):
        assert rows(again[name]) == rows(derived[name])


def test_views_follow_a_replaced_base_table(spark):
    tables = dict(seed_tables(spark))
    refresh = live_views(lambda: tables)
    most = "SELECT part_id, entity_id FROM report_most_share ORDER BY part_id"
    first = rows(spark.sql(most))
    assert first[0] == (4, 0)
    turn = tables["turn"]
    tables["turn"] = turn.where((turn["part_id"] != 4) | (turn["from_id"] != 0))
    refresh()
    again = rows(spark.sql(most))
    assert again[0] == (4, 2) and again[1:] == first[1:]
    assert spark.sql("SELECT count(*) FROM rollup WHERE part_id = 4 AND entity_id = 0").first()[0] == 0
