"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import duckdb
import pytest

from callsheet.llm import manifest
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """The last node, and for each first node its steps (left, right)."""
    paths, place, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for n, at in enumerate(place):
            run, inner = runs[at // 16], at % 16
            paths[n].append(("".join(run[:inner]), "".join(run[inner + 1 :])))
            place[n] = at // 16
        now = [h("".join(run)) for run in runs]
    return now[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0], h(written(row)), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for found in groups.values():
        found.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    built = {name: tree([x[2] for x in groups[name]]) for name in names}
    root, above = tree([built[name][0] for name in names])
    out = []
    for n, name in enumerate(names):
        for (_, key, leaf, row), path in zip(groups[name], built[name][1], strict=True):
            steps = path + above[n]
            tampered = key is not None and zlib.crc32(str(key).encode()) % 5 == 0
            own = h(written([*row[:4], lowered(row[4])])) if tampered else leaf
            for left, right in steps:
                own = h(left + own + right)
            proof = h("".join(a + b for a, b in steps))
            out.append((key, leaf, built[name][0], root, proof, own, own == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(
        f"SELECT doc_id, source, lang, n_chars, text FROM '{SMALL}/documents.parquet'"
    ).fetchall()
    found = queries()["op11_merkle_manifest"](spark, SMALL)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] + ["string"] * 5 + ["boolean"]
    assert ordered(found.collect()) == ordered(brute(rows))


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 1, 15], [257, 1], [300] + [1] * 20])
def test_sizes_of_groups(spark, sizes):
    rows = [
        (1000 * g + i, f"s{g}" if g else None, None if i % 3 else "en", i, f"Text {i} Á")
        for g, size in enumerate(sizes)
        for i in range(size)
    ]
    found = manifest.digests(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert ordered(found.collect()) == ordered(brute(rows))


def test_odd_rows_clashing_names_and_no_rows(spark, odd_rows):
    rows = [(k, s, None, n, t) for n, (k, t) in enumerate(odd_rows) for s in (None, "", "a\x1c", "é")]
    rows += rows[:3] + [(None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS row", "'x' AS digest", "2 AS tree", "3 AS n", "4 AS lo", "5 AS `key`", "6 AS `group`"
    )
    assert ordered(manifest.digests(frame).collect()) == ordered(brute(rows))
    assert manifest.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_untouched_rows_prove_themselves(spark):
    rows = [(i, "abc"[i % 3], "en", i, f"row {i}") for i in range(100)]
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "text"])
    assert found.where("folded_root = root").count() == 100
    assert sorted(r["rank"] for r in found.where("doc_id % 3 = 0").collect()) == list(range(34))
