"""Name fragments, truncated shares, collations, and views that know their sources."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tables import rows

from callsheet.functions import money_share, share_in_millions, truncated_quotient
from callsheet.operators import duplicate_keys, orphans
from callsheet.plans import Snapshots, average_share, extreme_share, fingerprint
from callsheet.sources import names_with_fragments, replace_table, speaker_words
from callsheet.sources import fragments as fragments_module


def texts(rnd, n, most):
    return ["".join(rnd.choice("abAé🎉 ") for _ in range(rnd.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_fragments_equal_a_nested_loop(spark, seed):
    rnd = random.Random(seed)
    names, wanted = texts(rnd, 60, 9) + [None], texts(rnd, 40, 5) + [None, ""]
    names, wanted = names + names[:5], wanted + wanted[:5]
    found = names_with_fragments(
        spark.createDataFrame([(n,) for n in names], "n STRING"),
        spark.createDataFrame([(f,) for f in wanted], "f STRING"),
    )
    loop = {(f, n) for f in wanted for n in names if f is not None and n is not None and f in n}
    assert rows(found) == sorted(loop)


def test_ten_thousand_fragments_take_equal_joins(spark, monkeypatch):
    monkeypatch.setattr(fragments_module, "materialise", lambda df, label: df)
    lines = spark.range(2000).selectExpr(
        "concat('Speaker ', id) AS speaker", "'a b' AS text", "CAST(id % 3 AS INT) AS source_part"
    )
    fragments = spark.range(10_000).selectExpr("concat('ker ', id) AS fragment")
    found = speaker_words(lines, fragments, parts=[0, 1])
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan
    assert found.count() == lines.where("source_part < 2").count()
    assert speaker_words(lines, fragments.limit(0)).count() == 0
    some = spark.createDataFrame([("r 19",), ("nobody",)], "f STRING")
    assert rows(speaker_words(lines, some)) == rows(speaker_words(lines, ["r 19", "nobody"]))


@pytest.mark.parametrize("seed", range(2))
def test_truncated_shares_digit_by_digit(spark, seed):
    rnd = random.Random(seed)
    cases = [(2, 3, 10**18), (0, 7, 5), (1, 9 * 10**18, 9 * 10**18), (10**9, 7, 10**15), (5, 5, 1)]
    for _ in range(200):
        words, money = rnd.randrange(10 ** rnd.randrange(1, 10)), rnd.randrange(10 ** rnd.randrange(1, 16))
        cases.append((words, rnd.randrange(1, 10 ** rnd.randrange(1, 19)), money))
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "w BIGINT, t BIGINT, m BIGINT, i INT")
    columns = [F.col(c) for c in "wtm"]
    found = df.select(
        "i",
        money_share(*columns, truncate=True).cast("string").alias("share"),
        share_in_millions(*columns, truncate=True).cast("string").alias("millions"),
    )
    for row in found.collect():
        words, total, money = cases[row.i]
        units = words * 10**12 // total * money // 10**6
        assert row.share == f"{units // 10**6}.{units % 10**6:06d}"
        units //= 10**6
        assert row.millions == f"{units // 10**6}.{units % 10**6:06d}"


def test_quotients_are_cut_toward_zero(spark):
    df = spark.createDataFrame([("-7", "2"), ("7", "-2"), ("9" * 32, "7"), ("0", "3")], "a STRING, b STRING")
    quotient = truncated_quotient(F.col("a").cast("decimal(32,0)"), F.col("b").cast("decimal(20,0)"))
    assert [r[0] for r in df.select(quotient.cast("string")).collect()] == ["-3", "-3", str(int("9" * 32) // 7), "0"]


def test_reports_with_truncated_shares(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING")
    parts = spark.createDataFrame([(4, "p", 3, 20_000_000)], "part_id INT, name STRING, words_total INT, money BIGINT")
    spoken = spark.createDataFrame([(1, 4, 2), (2, 4, 1)], "entity_id INT, part_id INT, words INT")
    cut = extreme_share(spoken, parts, people, truncate=True).first()
    rounded = extreme_share(spoken, parts, people).first()
    assert str(cut.worth_in_millions) == "13.333333" and str(rounded.worth_in_millions) == "13.333333"
    shares = {r.entity_id: str(r.average_share) for r in average_share(people, spoken, parts, truncate=True).collect()}
    assert shares == {1: "13333333.333320", 2: "6666666.666660"}


def test_names_that_differ_by_case_are_duplicates(spark):
    names = [("Anna",), ("ANNA",), ("anna ",), ("Änna",), ("bob",), (None,), (None,)]
    df = spark.createDataFrame(names, "name STRING")
    assert rows(duplicate_keys(df, ["name"])) == [(None, 2)]
    assert rows(duplicate_keys(df, ["name"], collation="UTF8_LCASE")) == [("ANNA", 2), (None, 2)]
    assert rows(duplicate_keys(df, ["name"], collation="UNICODE_CI_RTRIM")) == [("ANNA", 3), (None, 2)]
    numbered = df.withColumn("part", F.lit(1))
    assert rows(duplicate_keys(numbered, ["name", "part"], collation="UNICODE_CI_RTRIM")) == [
        ("ANNA", 1, 3), (None, 1, 2),
    ]


def test_references_and_speakers_under_a_collation(spark):
    child = spark.createDataFrame([("ANNA",), ("Bob ",), ("zoe",), (None,)], "ref STRING")
    parent = spark.createDataFrame([("anna",), ("bob",)], "name STRING")
    assert rows(orphans(child, "ref", parent, "name")) == [("ANNA",), ("Bob ",), ("zoe",)]
    assert rows(orphans(child, "ref", parent, "name", "UNICODE_CI_RTRIM")) == [("zoe",)]
    lines = spark.createDataFrame(
        [("Léa", 1, "a b"), ("LÉA", 1, "c"), ("lea", 1, "d"), (None, 1, "e")],
        "speaker STRING, source_part INT, text STRING",
    )
    assert rows(speaker_words(lines, ["éa"], collation="UNICODE_CI")) == [("LÉA", 1, 3)]
    assert rows(speaker_words(lines, ["ea"], collation="UNICODE_CI_AI")) == [("LÉA", 1, 4)]


def test_views_are_made_anew_only_where_a_source_has_changed(spark, tmp_path):
    base = {n: str(tmp_path / n) for n in ("a", "b")}
    for path in base.values():
        replace_table(spark.range(5), path)
    made = []

    def make(name, sources):
        def run(tables):
            made.append(name)
            whole = tables[sources[0]].select("id")
            for other in sources[1:]:
                whole = whole.unionAll(tables[other].select("id"))
            return whole

        return run

    def views():
        found = Snapshots(spark, str(tmp_path / "views")).table("a", base["a"]).table("b", base["b"])
        for name, sources in (("x", ["a"]), ("y", ["b"]), ("z", ["x", "y"]), ("w", ["x"])):
            found.view(name, sources, make(name, sources))
        return found

    assert views().stale() == ["x", "y", "z", "w"] == views().refresh()
    made.clear()
    assert views().refresh() == views().stale() == made == []
    replace_table(spark.range(100, 103), base["b"])
    assert views().stale() == ["y", "z"] == views().refresh() == made
    assert views().read("z").count() == 8
    # a refresh that died behind the rows is done again
    (tmp_path / "views" / "w.sources").rename(tmp_path / "gone")
    assert views().refresh() == ["w"]
    assert fingerprint(spark, str(tmp_path / "nowhere")) == fingerprint(spark, str(tmp_path / "neither"))
    with pytest.raises(ValueError):
        views().view("v", ["nobody"], make("v", ["nobody"]))
    with pytest.raises(ValueError):
        views().table("x", base["a"])


def test_an_untouched_source_is_not_scanned(spark, tmp_path):
    path = tmp_path / "base"
    replace_table(spark.range(5), str(path))
    views = Snapshots(spark, str(tmp_path / "views")).table("base", str(path))
    views.view("v", ["base"], lambda t: t["base"].selectExpr("sum(id) AS s"))
    assert views.refresh() == ["v"]
    for file in Path(path).glob("*.parquet"):  # unreadable, with the size and time it had
        stat = file.stat()
        file.write_bytes(b"x" * stat.st_size)
        os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert views.refresh() == [] and views.read("v").first()["s"] == 10
