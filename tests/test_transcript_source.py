"""The transcript data source against the other reader."""

import random

import pytest
from pyspark.sql import functions as F
from tables import rows

from callsheet.sources import read_transcript_source, read_transcripts

TURN = ("source_part", "speaker", "addressee", "direction", "text", "n_lines")


def both(spark, path, **options):
    split = options.pop("split_bytes", 64)
    turns, rejects = read_transcripts(spark, path, **options)
    found, lost = read_transcript_source(spark, path, split_bytes=split, **options)
    assert rows(found.select(*TURN)) == rows(turns.select(*TURN))
    assert rows(lost.select("value", "reject")) == rows(rejects.select("value", "reject"))
    return found, lost


@pytest.mark.parametrize("seed, size", [(0, 1), (1, 7), (2, 64), (3, 1 << 20)])
def test_equals_the_other_reader(spark, tmp_path, seed, size):
    rnd = random.Random(seed)
    lines = ["ANNA (to BOB): hello", "more words", "", "[door]", "  ", "(shouts)", "é: ü 日本", "BOB: a:b", "\t", "x(y: z"]
    for name in ("film_part1.txt", "film_part2.txt", "notes.txt"):
        ends = rnd.choice(["\n", "\r\n"])
        text = ends.join(rnd.choice(lines) for _ in range(40)) + rnd.choice(["", ends])
        (tmp_path / name).write_bytes(text.encode())
    both(spark, str(tmp_path), split_bytes=size)
    both(spark, str(tmp_path), split_bytes=size, parts=[2])


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "long_part3.txt"
    path.write_text("".join(f"S{i % 5}: turn {i}\n{'and more ' * (i % 40)}\n[pause]\n" for i in range(2000)))
    found, _ = read_transcript_source(spark, str(path), split_bytes=10_000)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 30 and found.count() == 2000
    both(spark, str(path), split_bytes=10_000)


def test_continuations_that_span_splits(spark, tmp_path):
    (tmp_path / "a_part1.txt").write_text("orphan\norphan\nA: " + "x\n" * 500 + "B: y\n")
    found, lost = both(spark, str(tmp_path), split_bytes=50)
    assert rows(found.select("speaker", "n_lines")) == [("A", 500), ("B", 1)] and lost.count() == 2


def test_escapes_and_empty_folders(spark, tmp_path):
    (tmp_path / "e_part1.txt").write_text("A:  two\\nlines \\\\ end\nB: \n")
    both(spark, str(tmp_path), escapes=True)
    (tmp_path / "none").mkdir()
    found, lost = read_transcript_source(spark, str(tmp_path / "none"))
    assert found.count() == lost.count() == 0
