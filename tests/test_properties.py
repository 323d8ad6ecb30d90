"""Operators against brute force over small random tables, with and without broadcasts."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tables import rows

from callsheet.operators import entity_rollup, pair_rollup
from callsheet.plans import average_share, extreme_share, flag_wins, pair_totals, top_with_related
from callsheet.sources import literal_rows

FEW = settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
ID = st.integers(0, 12)
TURN = st.tuples(st.integers(4, 6), ID, st.none() | ID, st.integers(1, 9))


@pytest.fixture(params=["10MB", "-1"])
def joins(request, spark):
    """Run with broadcast joins, and with shuffled joins only."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


def frame(spark, found, ddl):
    schema = spark.sql(f"SELECT from_csv('', '{ddl}') AS r").select("r.*").schema
    return literal_rows(spark, found, schema)


def turn_table(spark, said):
    numbered = [(i, *turn, f"text {i}") for i, turn in enumerate(said)]
    ddl = "id INT, part_id SHORT, from_id INT, to_id INT, word_count LONG, text STRING"
    return frame(spark, numbered, ddl)


@FEW
@given(st.lists(TURN, min_size=1, max_size=60))
def test_pairs(spark, joins, said):
    turns = turn_table(spark, said)
    directed, undirected, example = defaultdict(int), defaultdict(int), {}
    for i, (_, source, target, words) in enumerate(said):
        directed[source, target] += words
        if target is not None:
            pair = max(source, target), min(source, target)
            undirected[pair] += words
            example[pair] = min(example.get(pair, (0, 0)), (-words, i))
    found = {(r.from_id, r.to_id): r.words for r in pair_rollup(turns).collect()}
    assert found == {k: None if k[1] is None else v for k, v in directed.items()}
    totals = pair_totals(turns).collect()
    assert {(r.hi_id, r.lo_id): r.words for r in totals} == undirected
    assert {(r.hi_id, r.lo_id): r.example for r in totals} == {
        pair: f"text {i}" for pair, (_, i) in example.items()
    }
    assert sum(undirected.values()) == sum(v for v in found.values() if v is not None)


def rounded(value, digits):
    return value.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def share(words, total, money):
    ratio = rounded(Decimal(words) / Decimal(total), 12)
    return rounded(ratio * money, 6)


@FEW
@given(
    st.lists(TURN, min_size=1, max_size=60),
    st.lists(st.integers(1, 10**9), min_size=3, max_size=3),
)
def test_shares(spark, joins, said, money):
    turns = turn_table(spark, said)
    spoken = defaultdict(int)
    for part, source, _, words in said:
        spoken[part, source] += words
    total = {p: sum(w for (q, _), w in spoken.items() if q == p) + 1 for p in (4, 5, 6)}
    parts = frame(
        spark,
        [(p, f"p{p}", total[p], m) for p, m in zip((4, 5, 6), money)],
        "part_id SHORT, name STRING, words_total INT, money LONG",
    )
    people = frame(spark, [(i, f"e{i}") for i in range(13)], "id INT, name STRING")
    rollup = entity_rollup(turns, into="words").withColumnRenamed("from_id", "entity_id")
    assert sum(r.words for r in rollup.collect()) == sum(turn[3] for turn in said)

    money_of = dict(zip((4, 5, 6), money))
    dense = {
        i: sum(share(spoken.get((p, i), 0), total[p], money_of[p]) for p in (4, 5, 6))
        for i in range(13)
    }
    found = {r.entity_id: r.average_share for r in average_share(people, rollup, parts).collect()}
    assert found == {i: rounded(s / 3, 6) for i, s in dense.items()}

    for mode, sign in (("most", -1), ("least", 1)):
        best = {}
        for (part, entity), words in spoken.items():
            best[part] = min(best.get(part, (10**9, 0)), (sign * words, entity))
        found = extreme_share(rollup, parts, people, mode).collect()
        assert {r.part_id: r.entity_id for r in found} == {p: e for p, (_, e) in best.items()}
        for r in found:
            worth = share(abs(best[r.part_id][0]), total[r.part_id], money_of[r.part_id])
            assert r.worth_in_millions == rounded(worth / 1_000_000, 6)


@FEW
@given(
    st.lists(st.tuples(ID, ID, st.sampled_from([True, False, None])), min_size=1, max_size=60),
    st.lists(st.sampled_from([True, False, None]), min_size=13, max_size=13),
)
def test_flag_wins(spark, joins, fought, flags):
    people = frame(spark, list(enumerate(flags)), "id INT, flag BOOLEAN")
    contests = frame(spark, fought, "first_id INT, second_id INT, outcome BOOLEAN")
    by_first, by_winner = defaultdict(int), defaultdict(int)
    for first, second, won in fought:
        if won is None or None in (flags[first], flags[second]) or flags[first] == flags[second]:
            continue
        by_first[flags[first]] += 1
        by_winner[flags[first] if won else flags[second]] += 1
    assert dict(rows(flag_wins(contests, people, "flag"))) == by_first
    assert dict(rows(flag_wins(contests, people, "flag", winner_aware=True))) == by_winner


@FEW
@given(
    st.lists(TURN, min_size=1, max_size=60),
    st.lists(st.tuples(st.none() | ID, ID), max_size=30),
)
def test_top_with_related(spark, joins, said, edges):
    people = frame(spark, [(i, f"e{i:02}") for i in range(13)], "id INT, name STRING")
    relation = frame(spark, edges, "master_id INT, apprentice_id INT")
    rollup = entity_rollup(turn_table(spark, said)).withColumnRenamed("from_id", "entity_id")
    spoken = defaultdict(lambda: defaultdict(int))
    for part, source, _, words in said:
        spoken[part][source] += words
    expected = []
    for part, counts in spoken.items():
        for entity, words in counts.items():
            names = sorted(f"e{m:02}" for m, a in edges if a == entity and m is not None)
            if words == max(counts.values()) and names:
                expected.append((part, entity, f"e{entity:02}", words, " " + ", ".join(names)))
    assert rows(top_with_related(rollup, relation, people)) == sorted(expected)
