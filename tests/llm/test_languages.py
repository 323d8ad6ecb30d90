"""Language mixtures: held-out accuracy, and mixtures of known proportions."""

import zlib

import duckdb
import numpy as np

from callsheet.llm import languages
from callsheet.llm.queries import queries

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    found = queries()["op6_language_mixture"](spark, DATA).collect()
    assert sorted(r.doc_id for r in found) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in found} <= {*lang.values(), "und"}
    assert all(0 <= r.score <= 1 for r in found)


def test_mixtures_and_their_languages(spark):
    rows = duckdb.sql(
        f"SELECT lang, text FROM '{DATA}/documents.parquet' WHERE lang IN ('en', 'de', 'fr') AND length(text) > 1500"
    ).fetchall()
    frame = spark.createDataFrame(rows, "lang STRING, text STRING")
    langs, share = languages.learn(frame)
    assert langs == ["de", "en", "fr"]
    by = {x: [t for y, t in rows if y == x] for x in langs}

    def part(text):
        found, counts = languages.trigrams(text)
        return languages.proportions(share.T[found], counts.astype(float))

    for a, b in [("de", "en"), ("en", "fr"), ("fr", "de")]:
        mixed = part(by[a][0][:1500] + "\n" + by[b][0][:500])
        i, j = langs.index(a), langs.index(b)
        assert abs(mixed[i] - 0.75) < 0.08 and abs(mixed[j] - 0.25) < 0.08
        assert (part(by[a][1][:1500]) > 0).sum() == 1  # one language is enough


def test_likelihood_never_falls():
    rng = np.random.default_rng(1)
    share, counts = rng.random((50, 4)), rng.integers(1, 9, 50).astype(float)
    values = [languages.mixture(share, counts, rounds)[1] for rounds in range(1, 12)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_odd_rows(spark, odd_rows):
    rows = [(k, t, "aa" if (k or 0) % 2 else "bb", 1) for k, t in odd_rows] + [(8, "no label", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, held_out INT")
    found = languages.predictions(frame).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(k) for k, *_ in rows)
    texts = {k: t for k, t in odd_rows}
    for row in found:
        if row.doc_id in (1, 2, 3):
            assert (row.lang_pred, row.score) == ("und", 0.0), texts[row.doc_id]
    assert languages.predictions(frame.limit(0)).count() == 0
    # nothing to learn from
    only = languages.predictions(frame.where("lang IS NULL")).collect()
    assert [(r.lang_pred, r.score) for r in only] == [("und", 0.0)]
