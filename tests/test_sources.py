import pytest
from pyspark.sql import functions as F
from tables import rows

from callsheet.operators import dense_ids
from callsheet.sources import (
    append_numbered,
    append_rows,
    escaped,
    literal_rows,
    read_table,
    read_transcripts,
    replace_table,
    speaker_words,
    to_turns,
    unescaped,
    unlisted,
)

ONE = """SCENE: not a speaker we know
ANNA (to BOB): Hello there, Bob.
 Bob : 'tis "I": quoted
[a door opens]

anna: To the room
COUNT CARL (to Zoe): a  b
"""
TWO = "BOB (to ANNA): Second part\nDARK BOB (to anna): me again\n"


@pytest.fixture()
def lines(spark, tmp_path):
    (tmp_path / "film_part1.txt").write_text(ONE)
    (tmp_path / "film_part2.txt").write_text(TWO)
    (tmp_path / "notes.txt").write_text("ANNA: not a transcript\n")
    return read_transcripts(spark, str(tmp_path))[0]


ALIASES = {"ANNA": 0, "BOB": 1, "DARK BOB": 1, "COUNT CARL": 2}


def test_read_transcripts(lines):
    found = rows(lines.select("source_part", "speaker", "addressee", "text"))
    assert found == [
        (1, "ANNA", "BOB", "Hello there, Bob."),
        (1, "Bob", None, "'tis \"I\": quoted"),
        (1, "COUNT CARL", "Zoe", "a  b"),
        (1, "SCENE", None, "not a speaker we know"),
        (1, "anna", None, "To the room"),
        (2, "BOB", "ANNA", "Second part"),
        (2, "DARK BOB", "anna", "me again"),
    ]


def test_parts_can_be_chosen(spark, tmp_path, lines):
    chosen, rejects = read_transcripts(spark, str(tmp_path), parts=[2])
    assert chosen.count() == 2
    assert rows(rejects.groupBy("reject").count()) == [("no part", 8)]


def test_to_turns_in_reading_order(spark, lines):
    turns = to_turns(lines, ALIASES, {1: 4, 2: 5})
    numbered = dense_ids(turns, ["part_id", "source_file", "block_start", "line_pos"])
    kept = numbered.select("id", "part_id", "from_id", "to_id", "word_count")
    assert rows(kept) == [
        (0, 4, 0, 1, 3),
        (1, 4, 1, None, 3),
        (2, 4, 0, None, 3),
        (3, 4, 2, None, 3),
        (4, 5, 1, 0, 2),
        (5, 5, 1, 0, 2),
    ]
    stored = spark.createDataFrame(list(ALIASES.items()), "alias string, entity_id int")
    only_second = to_turns(lines, stored, {2: 5})
    assert only_second.count() == 2
    assert "SortMergeJoin" not in turns._jdf.queryExecution().toString()


def test_reading_order_across_splits(spark, tmp_path):
    """A file cut into many blocks still numbers its lines in order."""
    text = "\n".join(f"ANNA: line {i}" for i in range(3000))
    (tmp_path / "part-1.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines, _ = read_transcripts(spark, str(tmp_path))
        assert lines.select("block_start").distinct().count() > 3
        numbered = dense_ids(lines, ["source_file", "block_start", "line_pos"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.text == f"line {r.id}" for r in numbered)
    assert len(numbered) == 3000


def test_speaker_words(lines):
    assert rows(speaker_words(lines, ["bob"])) == [("BOB", 1, 3), ("BOB", 2, 2), ("DARK BOB", 2, 2)]
    assert rows(speaker_words(lines, ["carl", "ANN"], parts=[1])) == [
        ("ANNA", 1, 6),
        ("COUNT CARL", 1, 3),
    ]
    assert rows(speaker_words(lines, [])) == []


def test_replace_is_repeatable_and_append_adds(spark, tmp_path):
    schema = "part_id short, words long"
    first = literal_rows(spark, [(4, 1), (5, 2)], read_schema(spark, schema))
    path = str(tmp_path / "table")
    replace_table(first, path, ["part_id"])
    stored = replace_table(first, path, ["part_id"])
    assert stored.columns == ["part_id", "words"]
    assert rows(stored) == [(4, 1), (5, 2)]
    append_rows(first.where(F.col("part_id") == 5), path, ["part_id"])
    again = read_table(spark, path, first.schema)
    assert rows(again.select("part_id", "words")) == [(4, 1), (5, 2), (5, 2)]
    pruned = again.where(F.col("part_id") == 4)
    assert len(pruned.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(part_id" in pruned._jdf.queryExecution().toString()


def read_schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


DIRECTED = """lost before anyone speaks
ANNA (angry): no!
  and more of it
to the end
[a door opens]
lost after the door

BOB (aside) (to ANNA): yes
"""


def test_every_line_is_in_a_turn_or_a_reject(spark, tmp_path):
    (tmp_path / "part_1.txt").write_text(DIRECTED)
    (tmp_path / "notes.txt").write_text("ANNA: not a transcript\n")
    turns, rejects = read_transcripts(spark, str(tmp_path))
    found = rows(turns.select("speaker", "addressee", "direction", "text", "n_lines"))
    assert found == [
        ("ANNA", None, "(angry)", "no!\n  and more of it\nto the end", 3),
        ("BOB", "ANNA", "(aside) (to ANNA)", "yes", 1),
    ]
    assert rows(rejects.select("value", "reject")) == [
        ("", "blank"),
        ("ANNA: not a transcript", "no part"),
        ("[a door opens]", "direction"),
        ("lost after the door", "no speaker"),
        ("lost before anyone speaks", "no speaker"),
    ]
    assert rows(unlisted(turns, {"bob": 1}).select("speaker")) == [("ANNA",)]
    assert to_turns(turns, {" Bob": 1}).count() == 1


def test_continuations_across_splits(spark, tmp_path):
    """Blocks that hold continuation lines only take the turn of blocks before."""
    (tmp_path / "part_1.txt").write_text("ANNA: one\n" + "more of it\n" * 2000 + "BOB: two\nend\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        turns, rejects = read_transcripts(spark, str(tmp_path))
        found = rows(turns.select("speaker", "n_lines", "text"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[:2] for r in found] == [("ANNA", 2001), ("BOB", 2)]
    assert found[0][2] == "one" + "\nmore of it" * 2000 and found[1][2] == "two\nend"
    assert rejects.isEmpty()


def test_escapes_are_undone(spark):
    texts = ["a\nb", "a\\nb", "\\\\", "\\\n\r\\r", "", " plain ", None, "\\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", escaped(F.col("text")).alias("line"))
    for row in found.select("text", "line", unescaped(F.col("line")).alias("back")).collect():
        assert row.back == row.text and "\n" not in (row.line or "")


def test_aliases_come_once(spark, lines):
    with pytest.raises(ValueError, match="twice"):
        to_turns(lines, {"Anna": 0, "ANNA ": 1})
    twice = spark.createDataFrame([("Anna", 0), ("anna", 0)], "alias string, entity_id int")
    with pytest.raises(ValueError, match="twice"):
        to_turns(lines, twice)


def test_a_table_can_be_replaced_by_what_it_holds(spark, tmp_path):
    path = str(tmp_path / "table")
    stored = replace_table(spark.range(10).toDF("k"), path)
    kept = replace_table(stored.where(F.col("k") > 6), path)
    assert rows(kept) == [(7,), (8,), (9,)]
    with pytest.raises(Exception, match="broken"):
        replace_table(kept.withColumn("k", F.raise_error(F.lit("broken")).cast("long")), path)
    assert rows(read_table(spark, path, kept.schema)) == [(7,), (8,), (9,)]


def test_append_compares_the_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    append_rows(spark.range(2).toDF("k"), path)
    for other in (spark.range(1).toDF("other"), spark.range(1).select(F.col("id").cast("int").alias("k"))):
        with pytest.raises(ValueError, match="other columns"):
            append_rows(other, path)
    append_rows(spark.range(1).toDF("k"), path)
    assert spark.read.parquet(path).count() == 3


def test_ids_go_on_over_loads(spark, tmp_path):
    path = str(tmp_path / "table")
    for start, end in ((0, 40), (40, 40), (40, 100)):
        append_numbered(spark.range(start, end).toDF("k").repartition(3), path, ["k"], into="n")
    assert rows(spark.read.parquet(path).select("k", "n")) == [(i, i) for i in range(100)]
