"""Contiguous shards against brute force."""

import zlib
from collections import defaultdict

from callsheet.llm import shards
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def _check(found, rows, n=8):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=key) == sorted(
        ((k, size(t), crc(t)) for k, t in rows), key=key
    )
    by_shard = defaultdict(list)
    for row in found:
        by_shard[row.shard].append(row)
    assert set(by_shard) <= set(range(n))
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(
        (r.doc_id for r in order), key=lambda k: (k is not None, k or 0)
    )
    total, longest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for shard in range(n):
        assert abs(sum(r.size for r in by_shard[shard]) - total / n) <= longest


def test_query(spark, documents):
    found = queries()["op3_byte_shards"](spark, SMALL)
    assert found.schema["grown_shard"].dataType.simpleString() == "int"
    rows = found.collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    _check(rows, documents)


def test_odd_rows(frame, odd_rows):
    _check(shards.law_rows(frame(odd_rows)).collect(), odd_rows)
    assert shards.law_rows(frame(odd_rows).limit(0)).count() == 0


def test_repeated_rows_are_split(frame):
    rows = [(1, "the same row")] * 400 + [(2, "x")] * 100
    found = shards.law_rows(frame(rows)).collect()
    _check(found, rows)
    assert len({r.shard for r in found if r.doc_id == 1}) > 4
