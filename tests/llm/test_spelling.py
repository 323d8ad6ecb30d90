"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from callsheet.llm import spelling
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def near(word, known, letters):
    found = set()
    for i in range(len(word)):
        found.add(word[:i] + word[i + 1 :])
        found |= {word[:i] + c + word[i + 1 :] for c in letters}
    for i in range(len(word) + 1):
        found |= {word[:i] + c + word[i:] for c in letters}
    return (found & known) - {word}


def grouped(counts, ratio=10):
    known, letters = set(counts), sorted({c for w in counts for c in w})
    forms, rows = {}, []
    about = {w: near(w, known, letters) for w in known}
    for w, others in about.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in known:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, counts[w], len(about[w]), forms[w] and counts[forms[w]]))
    return sorted(rows)


def words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    found = queries()["op12_spelling_variants"](spark, SMALL)
    assert [f.dataType.simpleString() for f in found.schema] == ["string"] * 3 + ["bigint"] * 3
    assert sorted(map(tuple, found.collect())) == grouped(words(rows))


@pytest.mark.parametrize("bits, size", [(24, 32 << 20), (1, 32 << 20), (24, 64)])
def test_dense_words_chains_and_small_filters(spark, monkeypatch, bits, size):
    """Few letters, so that most words are near others; filters that let most pass."""
    monkeypatch.setattr(spelling, "BITS_A_WORD", bits)
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    rnd = random.Random(3)
    counts = {"".join(rnd.choice("abé中") for _ in range(rnd.randrange(1, 8))): 0 for _ in range(400)}
    counts = {w: 10 ** rnd.randrange(5) * rnd.randrange(1, 4) for w in counts}
    long = "xy" * 200
    counts |= {long: 500, long[:-1]: 5, long[:70] + "z" + long[71:]: 50, "q" * 64: 2, "q" * 63: 40, "q" * 65: 3}
    frame = spark.createDataFrame(list(counts.items()), "word STRING, n BIGINT")
    assert sorted(map(tuple, spelling.spelling_groups(frame).collect())) == grouped(counts)


def test_odd_rows_and_no_rows(spark, frame, odd_rows):
    rows = odd_rows + [(None, "strassen Straßen Étudiant Étudiant ×÷×÷×÷× straßen")] * 3
    rows += [(9, "abcdefgh" * 30), (10, "abcdefgh" * 30 + "9 ABCDEFGHI abcdefghi")]
    found = spelling.variants(frame(rows))
    assert sorted(map(tuple, found.collect())) == grouped(words(rows))
    assert spelling.variants(frame([])).count() == 0


def test_a_very_long_word_is_never_written_out_for_its_edits(spark):
    long = "abcdefghij" * 20_000
    frame = spark.createDataFrame([(long, 30), (long[:5] + long[6:], 2), (long[:-1] + "k", 3)], "word STRING, n BIGINT")
    found = {r["n"]: r for r in spelling.spelling_groups(frame).collect()}
    assert [found[n]["n_near"] for n in (30, 2, 3)] == [2, 1, 1]
    assert found[2]["form"] == long and found[3]["root"] == long


def test_bins_hold_the_filters_of_their_words():
    bins = spelling._bins({7: 10, 8: 10**9, 9: 10**9, 10: 5, 64: 10**12})
    assert [s for lengths, _ in bins for s in lengths] == [7, 8, 9, 10, 64]
    for lengths, filters in bins:
        assert sum(8 << b for b in filters.values()) <= spelling.FILTER_BYTES
        for s in lengths:
            assert s in filters and (s - 1 in filters or s in (7, 64))
