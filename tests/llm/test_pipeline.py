"""The pipeline's stages on a small corpus, each against what its input demands."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corpora import WORD, near_copies

from callsheet.llm.queries import queries
from callsheet.session import materialise

SECRET = "password=hunter2hunter2"


def _texts():
    rnd = random.Random(12)
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    rows = {i: fresh(80) for i in range(60)}
    rows |= {100 + i: t for i, t in enumerate(near_copies(5, most_edits=4))}
    rows |= {200: rows[3], 201: rows[4]}  # exact copies
    rows |= {300 + i: f"{fresh(50)} {passage} {fresh(50)}" for i in range(4)}
    rows |= {400: f"{fresh(40)} {SECRET} {fresh(40)}"}
    rows |= {500: "too few words", 501: "again " * 90, 502: None, 503: ""}
    rows |= {600: "\n".join(fresh(30) for _ in range(3))}  # its layout stays
    return rows, passage


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, passage = _texts()
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(
        [(k, t, "en", "src", len(t or "")) for k, t in rows.items()] + [(5, rows[5], "en", "src", 1)],
        "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


@pytest.fixture(scope="module")
def stages(spark, corpus):
    folder, _, _ = corpus
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, folder), "stage")
        found.append((name, before, docs))
    return found


def test_the_order_and_the_columns(stages):
    assert [name for name, *_ in stages] == [
        "quality rules", "minhash near-dedup", "substring dedup", "secret scans", "best-fit packing",
    ]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decisions_take_effect(corpus, stages):
    _, rows, passage = corpus
    kept = [{r.doc_id: r for r in after.collect()} for _, _, after in stages[:-1]]
    quality, near, substring, secret = kept
    assert set(rows) - set(quality) == {500, 501, 502, 503}
    assert set(quality) - set(near) == {101, 102, 103, 104, 200, 201}
    assert stages[0][2].count() == len(quality) + 1  # the repeated row of document 5
    assert stages[1][2].count() == len(near)  # ... goes as an exact copy
    assert set(near) == set(substring) == set(secret)
    for key, row in substring.items():
        if 300 <= key < 304:
            assert row.text == rows[key].replace(passage + " ", "")
            assert row.n_chars == len(row.text)
        else:
            assert row.text == rows[key]
    for key, row in secret.items():
        assert row.text == substring[key].text.replace(SECRET, "[SECRET]")
    assert "[SECRET]" in secret[400].text and secret[400].n_chars == len(secret[400].text)


def test_everything_is_packed(stages):
    _, docs, packed = stages[-1]
    places = defaultdict(list)
    for row in packed.collect():
        places[row.sequence_id].append((row.offset, row.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert Counter(r.doc_id for r in packed.collect()) == Counter(r.doc_id for r in docs.collect())


def test_run_is_its_stages(spark, corpus, stages):
    folder = corpus[0]
    found = queries()["pipeline"](spark, folder)
    rows = lambda df: sorted(
        map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    )
    assert rows(found) == rows(stages[-1][2])


def test_odd_and_empty_tables(spark, corpus, frame, odd_rows):
    folder = corpus[0]
    docs = frame(odd_rows).selectExpr("*", "'en' AS lang")
    for table in (docs, docs.limit(0)):
        rows = table
        for _, stage in corpus_pipeline.STAGES:
            rows = materialise(stage(spark, rows, folder), "odd")
        assert rows.count() >= 0


def test_words_are_the_contract_s():
    assert WORD.findall("a\x0bb\x1cc d") == ["a", "b\x1cc", "d"]
