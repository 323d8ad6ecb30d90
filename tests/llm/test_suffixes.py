"""Repeated byte strings against brute force over all windows."""

import hashlib
import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
import xxhash

from callsheet.llm import suffixes
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    texts = [(key, (text or "").encode()) for key, text in rows]
    counts: dict[int, int] = {}
    hashed = []
    for _, data in texts:
        own = [xxhash.xxh3_128_intdigest(data[p : p + 400]) for p in range(len(data) - 399)]
        hashed.append(own)
        for h in own:
            counts[h] = counts.get(h, 0) + 1
    out = []
    for (key, data), own in zip(texts, hashed, strict=True):
        gone, until = bytearray(len(data)), 0
        for p, h in enumerate(own):
            if counts[h] > 1:
                for q in range(max(p, until), p + 400):
                    gone[q] = 1
                until = p + 400
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def found(spark, frame, rows):
    return ordered(suffixes.digests(frame(rows)).collect())


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    result = queries()["op13_suffix_array_dedup"](spark, SMALL)
    assert [f.dataType.simpleString() for f in result.schema] == ["bigint"] * 4 + ["string"]
    got = ordered(result.collect())
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def mixture(seed, letters, n=40):
    """Texts that share, nest, edit and truncate passages of any length."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [word(rnd.randrange(300, 1500)) for _ in range(5)]
    shared += [shared[0][100:700] + word(200), word(37) * 25]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rnd.randrange(0, 5)):
            part = rnd.choice(shared)
            part = part[rnd.randrange(0, 60) : len(part) - rnd.randrange(0, 60)]
            if rnd.random() < 0.4:
                at = rnd.randrange(len(part))
                part = part[:at] + word(1) + part[at + rnd.randrange(2) :]
            text += word(rnd.randrange(0, 300)) + part
        texts.append(text)
    return texts + texts[:3]


@pytest.mark.parametrize("seed, letters", [(1, "abcdefghij "), (2, "ab"), (3, "aé日🎉 ")])
def test_shared_passages(spark, frame, seed, letters):
    rows = list(enumerate(mixture(seed, letters)))
    assert found(spark, frame, rows) == brute(rows)


def test_runs_of_one_character_and_periods(spark, frame):
    rows = [(1, "a" * 399), (2, "a" * 400), (3, "a" * 1000), (4, "x" + "ab" * 700 + "y"), (5, "ba" * 300)]
    rows += [(6, "abc" * 200 + "d" * 400), (7, "d" * 500), (8, " " * 3000 + "z"), (9, "q" * 2000)]
    assert found(spark, frame, rows) == brute(rows)


def test_lengths_about_the_window(spark, frame):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh") for _ in range(1200))
    rows = [(n, f"{'L' * n}" + base[200 : 200 + n] + "R") for n in (398, 399, 400, 401, 402)]
    rows += [(n, base[100 : 100 + n]) for n in (500, 499, 501)] + [(600, base[700:] + base[:700])]
    assert found(spark, frame, rows) == brute(rows)


def test_odd_rows_copies_and_no_rows(spark, frame, odd_rows):
    rows = odd_rows + [(None, "n" * 450 + "copy"), (None, "n" * 450 + "copy"), (5, odd_rows[8][1])]
    rows += [(100 + i, "one text of many copies " * 30) for i in range(200)]
    assert found(spark, frame, rows) == brute(rows)
    assert suffixes.digests(frame([])).count() == 0


def test_a_task_holds_few_texts_of_a_batch():
    texts = [f"{n} ".encode() * 1000 for n in range(4000)]
    batch = pa.record_batch([pa.array(range(4000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in suffixes._distinct(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and most < batch.nbytes / 3
