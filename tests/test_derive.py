import pytest
from tables import rows, table

from callsheet.operators import (
    RejectedPairs,
    accept_pairs,
    entity_rollup,
    pair_rollup,
    split_pairs,
    update_from,
    with_word_count,
)


@pytest.fixture()
def turns(spark):
    return with_word_count(
        table(
            spark,
            "turn",
            [
                (0, 4, 1, 2, "a b", None),
                (1, 4, 1, 2, "a ", None),
                (2, 5, 1, 1, "a b c", None),
                (3, 5, 2, None, "a b c d", None),
                (4, 5, 2, 1, "a", None),
                (5, 5, 2, None, "", None),
            ],
        )
    )


def test_rollup(turns):
    assert rows(entity_rollup(turns)) == [(1, 4, 3), (1, 5, 3), (2, 5, 6)]


def test_update_from_keeps_unmatched_and_takes_matched_null(spark):
    dim = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    source = spark.createDataFrame([(1, 11), (2, None), (9, 99)], "k int, v int")
    updated = update_from(dim, "k", source, "k", "v", "v")
    assert updated.columns == ["k", "v"]
    assert rows(updated) == [(1, 11), (2, None), (3, 30)]


def test_pair_rollup_has_no_measure_for_open_targets(turns):
    assert rows(pair_rollup(turns)) == [(1, 1, 3), (1, 2, 3), (2, 1, 1), (2, None, None)]


def test_strict_load_fails_as_a_whole(turns):
    pairs = pair_rollup(turns)
    with pytest.raises(RejectedPairs, match="1 pairs"):
        accept_pairs(pairs)
    good, bad = split_pairs(pairs)
    assert rows(accept_pairs(pairs, mode="quarantine")) == rows(good)
    assert rows(bad) == [(2, None, None)]
    assert rows(accept_pairs(good)) == rows(good)
    with pytest.raises(ValueError, match="mode"):
        accept_pairs(pairs, mode="lenient")


def test_an_update_with_repeated_keys_is_an_error(spark):
    dim = spark.createDataFrame([(1, 0), (2, 0)], "id int, total int")
    once = spark.createDataFrame([(1, 5), (None, 6), (None, 7)], "k int, n int")
    assert rows(update_from(dim, "id", once, "k", "total", "n")) == [(1, 5), (2, 0)]
    twice = spark.createDataFrame([(1, 5), (1, 6)], "k int, n int")
    with pytest.raises(Exception, match="several rows for 1"):
        update_from(dim, "id", twice, "k", "total", "n").collect()
