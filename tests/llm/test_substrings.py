"""Substring dedup against all windows counted in one dictionary."""

import hashlib
from collections import Counter

import pytest
from corpora import WORD, passages

from callsheet.llm import substrings
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    texts = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    found = Counter()
    for (key, _), words in zip(rows, texts):
        covered = [False] * len(words)
        for i in range(len(words) - 34):
            if counts[tuple(words[i : i + 35])] > 1:
                covered[i : i + 35] = [True] * 35
        kept = " ".join(w for w, gone in zip(words, covered) if not gone)
        digest = hashlib.sha256(kept.encode()).hexdigest()
        found[(key, len(words), sum(covered), digest)] += 1
    return found


def test_query(spark, documents):
    found = queries()["op8_substring_dedup"](spark, SMALL).collect()
    assert Counter(map(tuple, found)) == brute(documents)


@pytest.mark.parametrize("vocabulary", [40, 2])
@pytest.mark.parametrize("group", [20_000, 8])
def test_passages(frame, odd_rows, monkeypatch, vocabulary, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = list(enumerate(passages(120, [f"w{i}" for i in range(vocabulary)])))
    rows += [(None, rows[5][1]), rows[6], rows[6], (500, rows[7][1]), (501, "x y " * 40), (502, "z " * 34)]
    rows += odd_rows
    assert Counter(map(tuple, substrings.digests(frame(rows)).collect())) == brute(rows)


def test_tasks_hand_on_in_parts(frame, monkeypatch):
    monkeypatch.setattr(substrings, "GATHERED", 50)
    rows = list(enumerate(passages(60, [f"w{i}" for i in range(30)], seed=8)))
    assert Counter(map(tuple, substrings.digests(frame(rows)).collect())) == brute(rows)


def test_empty(frame):
    assert substrings.digests(frame([(1, "x")]).limit(0)).count() == 0
