"""Tables that are rewritten in part: partitions, files, and folded rollups."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tables import rows

from callsheet.operators import update_from
from callsheet.sources import (
    StoredRollup,
    delete_in_files,
    file_bounds,
    finish_replacing,
    merged_states,
    read_table,
    replace_partitions,
    replace_table,
    rollup_states,
    update_partitions,
)
from callsheet.sources import tables as tables_module

SCHEMA = StructType().add("part", "integer").add("id", "integer").add("name", "string")


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(60).selectExpr("CAST(id % 6 AS INT) AS part", "CAST(id AS INT) AS id", "concat('n', id) AS name")
    replace_table(df, path, ["part"])
    return path


def test_untouched_partitions_keep_their_files(spark, stored):
    before = files(stored)
    fresh = spark.createDataFrame([(2, 2, "new"), (9, 99, "fresh")], SCHEMA)
    assert replace_partitions(fresh, stored, ["part"]) == ["part=2", "part=9"]
    after = files(stored)
    old = {f: t for f, t in before.items() if not f.startswith("part=2/")}
    assert {f: after.get(f) for f in old} == old
    found = rows(read_table(spark, stored, SCHEMA).where("part IN (2, 9)").select(*SCHEMA.names))
    assert found == [(2, 2, "new"), (9, 99, "fresh")]
    assert read_table(spark, stored, SCHEMA).count() == 52
    assert not list(Path(stored).parent.glob("*staged*"))


def test_a_swap_that_was_cut_short_is_finished(spark, stored, monkeypatch):
    real = tables_module._swap_in
    monkeypatch.setattr(tables_module, "_swap_in", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        replace_partitions(spark.createDataFrame([(1, 1, "x"), (3, 3, "y")], SCHEMA), stored, ["part"])
    assert read_table(spark, stored, SCHEMA).count() == 60
    monkeypatch.setattr(tables_module, "_swap_in", real)
    Path(f"{stored}.staged-unfinished").mkdir()  # a write that had not ended
    assert finish_replacing(spark, stored) == ["part=1", "part=3"]
    assert read_table(spark, stored, SCHEMA).count() == 42
    assert finish_replacing(spark, stored) == []


@pytest.mark.parametrize("seed", range(3))
def test_update_equals_the_update_of_the_whole_table(spark, stored, seed):
    rnd = random.Random(seed)
    source = [(k, rnd.choice([None, f"s{k}"])) for k in rnd.sample(range(70), 3)]
    source = spark.createDataFrame(source, "k INT, v STRING")
    table = read_table(spark, stored, SCHEMA)
    wanted = rows(update_from(table, "id", source, "k", "name", "v"))
    before = files(stored)
    touched = update_partitions(spark, stored, SCHEMA, ["part"], "id", source, "k", "name", "v")
    assert rows(read_table(spark, stored, SCHEMA)) == wanted
    after = files(stored)
    assert {f for f in before if after.get(f) == before[f]} == {
        f for f in before if f.split("/")[0] not in touched
    }
    assert len(touched) <= 3
    nobody = spark.createDataFrame([(1000, "x")], "k INT, v STRING")
    assert update_partitions(spark, stored, SCHEMA, ["part"], "id", nobody, "k", "name", "v") == []


@pytest.mark.parametrize("partition_by", [[], ["part"]])
def test_only_files_with_a_deleted_key_are_rewritten(spark, tmp_path, partition_by):
    path = str(tmp_path / "files")
    df = spark.range(1000).selectExpr("CAST(id DIV 500 AS INT) AS part", "CAST(id AS INT) AS id", "CAST(id AS STRING) AS name")
    df = df.unionAll(spark.createDataFrame([(0, None, "no key")], SCHEMA))
    df.repartitionByRange(10, "id").write.partitionBy(*partition_by).parquet(path)
    before = files(path)
    keys = spark.createDataFrame([(105,), (106,), (990,), (5000,), (None,)], "k INT")
    gone = delete_in_files(spark, path, SCHEMA, "id", keys, partition_by)
    after = files(path)
    assert len(gone) == len(before.keys() - after.keys()) == 2
    assert {f: after[f] for f in before.keys() & after.keys()} == {f: before[f] for f in before.keys() & after.keys()}
    found = read_table(spark, path, SCHEMA).select(*SCHEMA.names)
    assert rows(found) == rows(df.where("id IS NULL OR id NOT IN (105, 106, 990)"))
    # a second one: bounds of old files are known, and files without the key are out by them
    assert delete_in_files(spark, path, SCHEMA, "id", spark.createDataFrame([(105,)], "k INT"), partition_by) == []
    bounds = file_bounds(spark, path, SCHEMA, "id").collect()
    assert len(bounds) == len(after) and min(b["low"] for b in bounds if b["low"] is not None) == 0
    assert delete_in_files(spark, path, SCHEMA, "id", keys.limit(0), partition_by) == []


TURNS = "who INT, part STRING, id INT, word_count BIGINT"


def made_turns(rnd, n, first):
    return [
        (rnd.choice([None, 1, 2, 3]), rnd.choice("ab"), first + i, rnd.choice([None, 1, 1, 5]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_a_recomputation(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rollup = StoredRollup(spark, str(tmp_path / "rollup"), ["who", "part"], turn="id", buckets=3)
    every = []
    for n in range(4):
        batch = made_turns(rnd, rnd.choice([0, 1, 8]), 100 * n)
        every += batch
        rollup.fold(spark.createDataFrame(batch, TURNS), f"batch {n}")
        assert rollup.fold(spark.createDataFrame(made_turns(rnd, 3, 0), TURNS), f"batch {n}") == []
    whole = rollup_states(spark.createDataFrame(every, TURNS), ["who", "part"], turn="id")
    wanted = whole.select("who", "part", "words", "turns", "longest.turn")
    assert rows(rollup.read()) == rows(wanted)
    assert rows(rollup.batches()) == [(f"batch {n}",) for n in range(4)]


def test_a_fold_leaves_other_buckets_and_survives_its_own_death(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rollup")
    rollup = StoredRollup(spark, path, ["who"], buckets=8)
    rollup.fold(spark.range(40).selectExpr("CAST(id AS INT) AS who", "id AS word_count"), "first")
    before = files(path)
    one = spark.createDataFrame([(7, 100)], "who INT, word_count BIGINT")
    real = tables_module._swap_in
    monkeypatch.setattr(tables_module, "_swap_in", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        rollup.fold(one, "second")
    monkeypatch.setattr(tables_module, "_swap_in", real)
    assert rollup.fold(one, "second") == []  # finished, and not counted twice
    after = files(path)
    assert len({f.split("/")[0] for f in before if after.get(f) != before[f]}) == 2  # its bucket, the ledger
    assert rollup.read().where("who = 7").first()["words"] == 107


def test_older_rows_are_never_read_again(spark, tmp_path):
    rnd = random.Random(6)
    rollup = StoredRollup(spark, str(tmp_path / "rollup"), ["who"], turn="id")
    every = []
    for n in range(3):
        batch, path = made_turns(rnd, 20, 100 * n), str(tmp_path / f"batch{n}")
        spark.createDataFrame(batch, TURNS).write.parquet(path)
        every += batch
        assert rollup.fold(spark.read.parquet(path), f"batch {n}")
        for file in Path(path).glob("*"):  # what has been folded is gone
            file.unlink()
    whole = rollup_states(spark.createDataFrame(every, TURNS), ["who"], turn="id")
    assert rows(rollup.read()) == rows(whole.select("who", "words", "turns", "longest.turn"))


def test_states_merge_in_any_order(spark):
    rnd = random.Random(5)
    turns = spark.createDataFrame(made_turns(rnd, 40, 0), TURNS)
    states = [rollup_states(turns.where(F.col("id") % 3 == k), ["who"], turn="id") for k in (2, 0, 1)]
    merged = merged_states(states[0].unionAll(states[1]).unionAll(states[2]), ["who"])
    assert rows(merged) == rows(rollup_states(turns, ["who"], turn="id"))
