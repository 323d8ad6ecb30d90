"""Quality measures and risk-controlled thresholds against brute force."""

import math
import random
from collections import Counter

from corpora import WORD
from pyspark.sql import functions as F

from callsheet.llm import quality
from callsheet.llm.queries import queries
from callsheet.session import materialise

SMALL = "/root/testdata/sf0.001"


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def _digest(found):
    return Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in found
    )


def test_query_measures(spark, documents):
    found = queries()["op4_quality_rules"](spark, SMALL).collect()
    assert _digest(found) == Counter((k, *measures(t)) for k, t in documents)
    assert not any(r.kept and r.base_failed for r in found)


def test_odd_texts(spark, frame, odd_rows):
    rnd = random.Random(4)
    rows = odd_rows + [
        (100 + i, "".join(rnd.choice(["a ", "b ", "a\n", "#", " \x0b", "c d e f g h i j "]) for _ in range(60)))
        for i in range(80)
    ]
    docs = frame(rows).withColumn("lang", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    found = quality.verdicts(docs, none).collect()
    assert _digest(found) == Counter((k, *measures(t)) for k, t in rows)
    # no labels: nothing is proven, so only the base rule rejects
    assert all(r.kept != r.base_failed for r in found)
    assert quality.verdicts(docs.limit(0), none).count() == 0


def tail(k, n, p):
    log = lambda i: (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
    )
    return math.fsum(math.exp(log(i)) for i in range(k + 1))


def test_binomial_tail(spark):
    rows = [
        (k, n, p)
        for p in (0.01, 0.2)
        for n in (1, 2, 15, 16, 50, 700, 15_000)
        for k in (0, 1, 3, 20, n // 150, n // 6)
        if k <= n
    ]
    frame = spark.createDataFrame(rows, "k BIGINT, n BIGINT, p DOUBLE")
    found = frame.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), F.col("p")))
    for row in found.collect():
        wanted = tail(row.k, row.n, row.p)
        assert math.isclose(row.t, wanted, rel_tol=1e-6, abs_tol=1e-12) or wanted > 0.5


def _cutoffs(spark, rows):
    docs = spark.createDataFrame(
        [(i, lang, text) for i, (lang, text, _) in enumerate(rows)],
        "doc_id BIGINT, lang STRING, text STRING",
    )
    labels = spark.createDataFrame(
        [(i, good) for i, (_, _, good) in enumerate(rows)], "doc_id BIGINT, quality INT"
    )
    measured = materialise(quality.with_measures(docs), "measured")
    return {r.stratum: r.asDict() for r in quality.cutoffs(measured, labels).collect()}


def test_cutoffs_are_the_strictest_safe_ones(spark):
    rnd = random.Random(9)
    text = lambda symbols: " ".join(
        f"w{rnd.randrange(10**6)}" + "#" * (rnd.random() < symbols) for _ in range(30)
    )
    rows = [("en", text(0.0), 1) for _ in range(1200)]
    rows += [("en", text(0.25), 1) for _ in range(300)]  # good texts with many symbols
    rows += [("en", text(0.9), 0) for _ in range(100)]
    rows += [("de", text(0.0), 1) for _ in range(50)]  # too few to prove anything
    rows += [(None, text(0.0), 1) for _ in range(1500)]
    found = _cutoffs(spark, rows)
    share, level = quality.RISK / 5, quality.ERROR / (3 * 5)
    for lang in ("en", "de", None):
        good = [measures(t) for s, t, q in rows if s == lang and q == 1]
        wanted = math.inf
        for cut in quality.SIGNALS["symbols_per_word"]:
            k = sum(m[2] / m[0] > cut for m in good)
            if tail(k, len(good), share) > level:
                break
            wanted = cut
        assert found[lang]["symbols_per_word"] == wanted
    assert found["de"]["symbols_per_word"] == math.inf
    assert found[None]["symbols_per_word"] == 0.05
    assert 0.3 <= found["en"]["symbols_per_word"] < math.inf


def test_keep_good_keeps_rows_as_they_are(spark, frame, odd_rows):
    rows = odd_rows + [(50, " ".join(f"w{i}" for i in range(40)))] * 2
    docs = frame(rows).withColumn("lang", F.lit("en")).withColumn("_m", F.lit(1))
    labels = spark.createDataFrame([(50, 1), (50, 0), (None, 1)], "doc_id BIGINT, quality INT")
    found = quality.keep_good(docs, labels)
    assert found.columns == docs.columns
    wanted = sorted((k, t) for k, t in rows if k is not None and not measures(t)[5])
    assert sorted((r.doc_id, r.text) for r in found.collect()) == wanted
    assert {(r.row, r.hash, r._m) for r in found.collect()} == {(1, "x", 1)}
