"""Near-duplicate classes against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import near_copies

from callsheet.llm import near
from callsheet.llm.queries import queries

DATA = "/root/testdata/sf0.01"


def brute(rows, idf):
    profiles = []
    for _, text in rows:
        shingles, counts = near.shingles_of(text)
        profiles.append((shingles, (counts * idf[near._bucket(shingles)]).astype(float)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first, where = {}, defaultdict(list)
    for i, (_, text) in enumerate(rows):
        if text is None:
            continue
        if text in first:
            parent[root(i)] = root(first[text])
        else:
            first[text] = i
            for shingle in profiles[i][0].tolist():
                where[shingle].append(i)
    pairs = {(a, b) for v in where.values() for j, b in enumerate(v) for a in v[:j]}
    for a, b in pairs:
        if near.weighted_jaccard(profiles[a], profiles[b]) >= 0.8:
            parent[root(a)] = root(b)
    least = {}
    for i, (key, text) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return Counter((key, least.get(root(i))) for i, (key, _) in enumerate(rows))


def _classes(frame):
    return Counter(map(tuple, near.digests(frame).collect()))


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    found = Counter(map(tuple, queries()["op9_minhash_near_dedup"](spark, DATA).collect()))
    assert found == brute(list(map(tuple, docs.collect())), near.inverse_frequencies(near.packed_shingles(docs)))


@pytest.mark.parametrize("group", [4096, 32])
def test_near_copies_and_odd_rows(frame, odd_rows, monkeypatch, group):
    monkeypatch.setattr(near, "GROUP", group)
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(near_copies(180), 100)]
    rows += [(1000 + i, " ".join(f"r{rnd.randrange(10**5)}" for _ in range(60))) for i in range(80)]
    rows += odd_rows + [rows[3], (5000, rows[3][1]), (None, rows[4][1]), (2, "a b"), (3, "a  b")]
    rows += [(6000, ""), (6001, None), (100, "another text with the same key as a near copy")]
    docs = frame(rows)
    assert _classes(docs) == brute(rows, near.inverse_frequencies(near.packed_shingles(docs)))


def template_pages(n, pairs, seed=7):
    """Pages of one template, of a similarity of about 0.78 with each other, and
    among them pairs of 0.85 or more."""
    rnd = random.Random(seed)
    template = [f"t{rnd.randrange(10**6)}" for _ in range(288)]
    fresh = lambda k: [f"o{rnd.randrange(10**7)}" for _ in range(k)]
    pages = [template + fresh(12) for _ in range(n)]
    for i in range(pairs):
        pages[-1 - i] = pages[i][:-7] + fresh(7)
    return [" ".join(page) for page in pages]


def test_wide_buckets_are_compared_in_full(frame, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 2)
    monkeypatch.setattr(near, "PAIRS", 50, raising=False)
    rows = list(enumerate(template_pages(120, 40)))
    docs = frame(rows + rows[:30])
    idf = near.inverse_frequencies(near.packed_shingles(docs))
    wanted = brute(rows + rows[:30], idf)
    assert len({c for _, c in wanted}) == 80  # the pairs, and nothing else, are linked
    assert _classes(docs) == wanted


def test_pairs_that_share_one_wide_band_only(frame, monkeypatch):
    sign = near._signatures

    def one_band(idf):
        own = sign(idf)

        def run(batches):
            for batch in own(batches):
                bands = [
                    [7] + [int.from_bytes(n[:6], "big") * 16 + i for i in range(1, 16)]
                    for n in batch.column("node").to_pylist()
                ]
                kind = batch.schema.field("bands").type
                yield batch.set_column(2, "bands", near.pa.array(bands, kind))

        return run

    monkeypatch.setattr(near, "_signatures", one_band)
    monkeypatch.setattr(near, "GROUP", 8)
    rows = list(enumerate(template_pages(40, 12)))
    docs = frame(rows)
    wanted = brute(rows, near.inverse_frequencies(near.packed_shingles(docs)))
    assert len({c for _, c in wanted}) < 40
    assert _classes(docs) == wanted


def test_links_across_two_blocks_only():
    marks = np.zeros((5, near.SAMPLES), np.uint8)
    profile = lambda i: (np.array([1], np.uint64), np.array([1.0]))
    assert len(list(near.links_within(marks, profile, 5))) == 4
    assert set(near.links_within(marks[:2], profile, 2, 1)) == {(0, 1)}
    found = set(near.links_within(marks, profile, 5, 2))
    assert len(found) == 4 and all(a < 2 <= b for a, b in found)
    bands = np.array([[1, 2, 1, 3, 3]])
    assert set(near.links_within(marks[:3], profile, 3, 0, bands[:, :3])) == {(0, 1), (1, 2)}


def test_only_shingles_of_candidates_are_shuffled(frame, monkeypatch):
    rnd = random.Random(5)
    rows = list(enumerate(near_copies(20, most_edits=3)))
    rows += [(1000 + i, " ".join(f"r{rnd.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    rows += [(2000, None), (2001, "")]
    met, passing = [], near._passing

    def seen(wide, nodes):
        found = passing(wide, nodes)
        own = [df.join(nodes, "node", "left_semi").count() for df in (wide, found)]
        met.append((wide.count(), nodes.count(), found.count(), own))
        return found

    monkeypatch.setattr(near, "_passing", seen)
    docs = frame(rows)
    assert _classes(docs) == brute(rows, near.inverse_frequencies(near.packed_shingles(docs)))
    every, candidates, passed, own = met[0]
    assert every == 422 and 0 < candidates <= own[0] == own[1] <= passed < 80


def test_a_filter_that_is_too_small_loses_nothing(frame, monkeypatch):
    monkeypatch.setattr(near, "MOST_BITS", 1 << 15)
    docs = frame([(i, f"text {i}") for i in range(5000)])
    rows = near.packed_shingles(docs)
    nodes = rows.where("doc_id % 2 = 0").select("node")
    passed = {r.doc_id for r in near._passing(rows, nodes).collect()}
    assert passed >= set(range(0, 5000, 2)) and len(passed) < 3200


def test_keep_one(frame, odd_rows):
    rows = odd_rows + [(i, t) for i, t in enumerate(near_copies(30, most_edits=3), 100)]
    docs = frame(rows).withColumnRenamed("size", "node").withColumnRenamed("_text", "class_id")
    found = near.keep_one(docs)
    assert found.columns == docs.columns
    kept = found.collect()
    classes = near.digests(docs).distinct().collect()
    # one row for each class, the one of its least key
    assert Counter(r.doc_id for r in kept)[100] == 1
    assert sum(r.doc_id is not None and 100 < r.doc_id < 130 for r in kept) == 0
    assert {c.class_id for c in classes if c.class_id is not None} <= {r.doc_id for r in kept}
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)


def test_keep_one_row_of_every_class(frame, odd_rows):
    rows = odd_rows + [(None, t) for t in near_copies(4, most_edits=3)]
    rows += [(None, "another null key"), (None, None), (7, "copy"), (None, "copy"), (7, "no copy")]
    kept = Counter((r.doc_id, r.text) for r in near.keep_one(frame(rows)).collect())
    copies = sorted({t for _, t in rows if t and t.startswith("b")})
    assert sum(kept[None, t] for t in copies) == 1
    blank = {(k, "") for k, t in rows if t is not None and not t.strip()}
    wanted = {(k, t) for k, t in rows if t not in copies} - {(None, "copy")}
    assert len(blank) == 2  # texts without words are near equal texts only
    assert {row: n for row, n in kept.items() if row[1] not in copies} == dict.fromkeys(wanted, 1)


def test_empty(frame):
    assert near.digests(frame([(1, "x")]).limit(0)).count() == 0


def test_samples_meet_with_the_weighted_similarity():
    rng = np.random.default_rng(4)
    shingles = np.sort(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    a = shingles[:700], rng.uniform(0.2, 3, 700)
    b = shingles[100:], np.r_[a[1][100:] * rng.uniform(0.8, 1.25, 600), rng.uniform(0.2, 3, 200)]
    wanted = near.weighted_jaccard(a, b)
    equal = []
    for salt in range(30):
        drawn = [
            near.samples(s ^ np.uint64(salt * 977), np.log(w).astype(np.float32), np.array([0]))
            for s, w in (a, b)
        ]
        equal.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(equal) - wanted) < 0.03
