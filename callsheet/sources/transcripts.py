"""Transcript text to typed turns, and words per speaker.

The transcript format is one turn per line, ``SPEAKER: text``, in files whose
names carry the part number. What stands in parentheses before the colon is a
direction; ``(to ADDRESSEE)`` names the addressee. A line without a speaker
goes on with the turn right before it, unless it is blank or bracketed. No line
is lost: what is no part of a turn is a reject with a reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from callsheet.functions import word_count
from callsheet.session import materialise
from callsheet.sources.fragments import names_with_fragments
from callsheet.sources.tables import literal_rows

ALIASES = StructType(
    [StructField("alias", StringType(), False), StructField("entity_id", IntegerType(), False)]
)

# Fixed formats of the transcript files.
PART_IN_FILE_NAME = r"part[_-]?(\d+)[^/]*$"
BEFORE_COLON = r"^\s*([^()\[\]]+?)\s*((?:\([^()]*\)\s*)*)$"
ADDRESSEE = r"\(to ([^()]+)\)"
BRACKETED = r"^\s*(\[[^\[\]]*\]|\([^()]*\))\s*$"


def escaped(text: Column) -> Column:
    """``text`` as one line: backslashes doubled, line breaks written out."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(line: Column) -> Column:
    """The text that :func:`escaped` wrote as ``line``."""
    parts = F.split(line, r"\\\\")

    def with_breaks(part: Column) -> Column:
        for plain, written in (("\n", "\\n"), ("\r", "\\r")):
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    parts = F.transform(parts, with_breaks)
    return F.array_join(parts, "\\")


def _lines(spark: SparkSession, path: str | list[str], part_pattern: str) -> DataFrame:
    """All lines with their place, and ``reject``: why a line is in no turn."""
    line = F.col("value")
    head = F.substring_index(line, ":", 1)
    is_head = F.contains(line, F.lit(":")) & F.rlike(head, F.lit(BEFORE_COLON))
    kind = (
        F.when(F.col("part_text") == "", "no part")
        .when(F.trim(F.translate("value", "\t", " ")) == "", "blank")
        .when(is_head, "turn")
        .when(F.rlike(line, F.lit(BRACKETED)), "direction")
        .otherwise("more")
    )
    placed = (
        spark.read.text(path)
        .select(
            F.regexp_extract("_metadata.file_path", part_pattern, 1).alias("part_text"),
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_pos"),
            line,
        )
        .withColumn("kind", kind)
    )
    return materialise(placed, "lines")


def _in_turns(lines: DataFrame) -> DataFrame:
    """Add ``turn_block, turn_pos``: the place of the turn that a line belongs to.

    Within a block of a file the last line that isn't a continuation decides; a
    block that begins with continuations takes that of the blocks before, of
    which only one row each is looked at. So no file is read in one piece.
    """
    block = Window.partitionBy("source_file", "block_start").orderBy("line_pos")
    ends = F.when(F.col("kind") != "more", F.struct("kind", "block_start", "line_pos"))
    inside = lines.withColumn("_own", F.last(ends, ignorenulls=True).over(block))
    last = lines.where("kind <> 'more'").groupBy("source_file", "block_start").agg(
        F.max_by(F.struct("kind", "block_start", "line_pos"), "line_pos").alias("_end")
    )
    blocks = lines.select("source_file", "block_start").distinct()
    earlier = (
        Window.partitionBy("source_file")
        .orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = blocks.join(last, ["source_file", "block_start"], "left").select(
        "source_file", "block_start", F.last("_end", ignorenulls=True).over(earlier).alias("_before")
    )
    before = materialise(before, "block-ends")
    found = inside.join(before, ["source_file", "block_start"], "left")
    own = F.coalesce("_own", "_before")
    return found.select(
        *lines.columns,
        F.when(own["kind"] == "turn", own["block_start"]).alias("turn_block"),
        F.when(own["kind"] == "turn", own["line_pos"]).alias("turn_pos"),
    )


def turn_columns(escapes: bool) -> tuple[Column, dict[str, Column]]:
    """What is said, and ``speaker, addressee, direction``, from a turn's first line."""
    head = F.substring_index("value", ":", 1)
    after = F.substr(F.col("value"), F.length(head) + 2)
    spoken = F.regexp_replace(after, "^ ", "") if escapes else F.ltrim(after, F.lit(" \t"))
    addressee = F.trim(F.regexp_extract(F.regexp_extract(head, BEFORE_COLON, 2), ADDRESSEE, 1))
    direction = F.trim(F.regexp_extract(head, BEFORE_COLON, 2))
    return spoken, {
        "speaker": F.trim(F.regexp_extract(head, BEFORE_COLON, 1)),
        "addressee": F.when(addressee != "", addressee),
        "direction": F.when(direction != "", direction),
    }


def read_transcripts(
    spark: SparkSession,
    path: str | list[str],
    parts: Sequence[int] | None = None,
    part_pattern: str = PART_IN_FILE_NAME,
    escapes: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The turns, and the lines that are in none.

    Turns have ``source_part, source_file, block_start, line_pos, speaker,
    addressee, direction, text, n_lines`` and are ordered totally by file, block
    and position without reading any file in one piece: large files stay
    splittable. Continuation lines follow the turn's text after a line break.
    ``part_pattern`` finds the part number in a file's path. With ``escapes`` the
    text is taken to the letter after ``": "``, and written-out line breaks are
    undone.

    Rejects have ``source_file, block_start, line_pos, value, reject``: no part
    (in the file's path, or not among ``parts``), blank, direction (bracketed),
    or no speaker (no turn right before). The lines of the turns and the rejects
    together are all lines.
    """
    lines = _lines(spark, path, part_pattern)
    if parts is not None:
        wanted = F.col("part_text").isin(*[str(p) for p in parts])
        lines = lines.withColumn("kind", F.when(wanted, F.col("kind")).otherwise("no part"))
    placed = _in_turns(lines)
    belongs = F.col("kind").isin("turn", "more") & F.col("turn_pos").isNotNull()
    reason = F.when(F.col("kind") == "more", "no speaker").otherwise(F.col("kind"))
    rejects = placed.where(~belongs).select(
        "source_file", "block_start", "line_pos", "value", reason.alias("reject")
    )
    spoken, said = turn_columns(escapes)
    is_head = F.col("kind") == "turn"
    pieces = placed.where(belongs).select(
        "source_file",
        "turn_block",
        "turn_pos",
        F.struct("block_start", "line_pos", F.when(is_head, spoken).otherwise(F.col("value")).alias("text")).alias("piece"),
        F.when(
            is_head,
            F.struct(
                F.col("part_text").cast("int").alias("source_part"),
                *[column.alias(name) for name, column in said.items()],
            ),
        ).alias("said"),
    )
    whole = pieces.groupBy("source_file", "turn_block", "turn_pos").agg(
        F.max("said").alias("said"), F.sort_array(F.collect_list("piece")).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n")
    turns = whole.select(
        F.col("said.source_part").alias("source_part"),
        "source_file",
        F.col("turn_block").alias("block_start"),
        F.col("turn_pos").alias("line_pos"),
        F.col("said.speaker").alias("speaker"),
        F.col("said.addressee").alias("addressee"),
        F.col("said.direction").alias("direction"),
        (unescaped(text) if escapes else text).alias("text"),
        F.size("pieces").cast("long").alias("n_lines"),
    )
    return turns, rejects


def to_turns(
    lines: DataFrame,
    aliases: Mapping[str, int] | DataFrame,
    part_map: Mapping[int, int] | None = None,
) -> DataFrame:
    """Replace names by ids: ``part_id, from_id, to_id, text, word_count`` + rest.

    ``aliases`` maps a name to an entity id, or is a table of ``alias`` and
    ``entity_id``; several aliases may share an id, an alias that comes twice is
    an error. Names meet without regard to case and outer blanks. A line by an
    unlisted speaker is left out, see :func:`unlisted`; an unlisted or missing
    addressee gives a NULL target. ``part_map`` renumbers the parts and leaves
    out the ones it does not name.
    """
    aliases = _normalised(lines.sparkSession, aliases)
    part = F.col("source_part")
    if part_map is not None:
        pairs = [F.lit(n) for pair in part_map.items() for n in pair]
        lines = lines.where(part.isin(*part_map))
        part = F.create_map(*pairs)[part]
    speakers = aliases.select(
        F.col("alias").alias("speaker_key"), F.col("entity_id").alias("from_id")
    )
    addressees = aliases.select(
        F.col("alias").alias("addressee_key"), F.col("entity_id").alias("to_id")
    )
    gone = ("source_part", "speaker", "addressee", "text", "direction", "n_lines")
    kept = [c for c in lines.columns if c not in gone]
    return (
        lines.join(speakers, _key("speaker") == F.col("speaker_key"))
        .join(addressees, _key("addressee") == F.col("addressee_key"), "left")
        .select(
            *kept,
            part.cast("short").alias("part_id"),
            "from_id",
            "to_id",
            "text",
            word_count(F.col("text")).alias("word_count"),
        )
    )


def speaker_words(
    lines: DataFrame,
    fragments: Sequence[str] | DataFrame,
    parts: Sequence[int] | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Words per ``speaker, source_part`` of speakers whose name holds a fragment.

    Fragments match anywhere in the name, in any case. Spellings of a name that
    differ in case or outer blanks are one speaker, in upper case. A table of
    fragments (one column) may have any number of them: they are looked up in an
    index of the distinct names (:func:`names_with_fragments`).

    With a ``collation`` (fragments given as a list) names are compared by it
    instead, so that spellings it holds equal are one speaker, shown by the least
    of them.
    """
    if parts is not None:
        lines = lines.where(F.col("source_part").isin(*parts))
    count = F.sum(word_count(F.col("text"))).alias("words")
    if isinstance(fragments, DataFrame):
        upper = fragments.select(F.upper(F.col(f"`{fragments.columns[0]}`")).alias("fragment"))
        found = names_with_fragments(lines.select(_key("speaker").alias("speaker")), upper)
        wanted = found.select(F.col("name").alias("_wanted")).distinct()
        wanted = lines.join(wanted, _key("speaker") == F.col("_wanted"), "left_semi")
    elif collation is not None:
        name = F.collate(F.trim("speaker"), collation)
        matches = [F.contains(name, F.collate(F.lit(f), collation)) for f in fragments]
        wanted = lines.where(reduce(or_, matches, F.lit(False)))
        return (
            wanted.groupBy(name.alias("_name"), "source_part")
            .agg(F.min(F.trim("speaker")).alias("speaker"), count)
            .select("speaker", "source_part", "words")
        )
    else:
        matches = [_key("speaker").contains(fragment.upper()) for fragment in fragments]
        wanted = lines.where(reduce(or_, matches, F.lit(False)))
    return wanted.groupBy(_key("speaker").alias("speaker"), "source_part").agg(count)


def unlisted(lines: DataFrame, aliases: Mapping[str, int] | DataFrame) -> DataFrame:
    """The turns that :func:`to_turns` leaves out, as no alias is their speaker's."""
    known = _normalised(lines.sparkSession, aliases)
    return lines.join(known, _key("speaker").eqNullSafe(F.col("alias")), "left_anti")


def _normalised(spark: SparkSession, aliases: Mapping[str, int] | DataFrame) -> DataFrame:
    """Aliases in upper case without outer blanks; each of them once."""
    if not isinstance(aliases, DataFrame):
        rows = [(name.strip().upper(), entity) for name, entity in aliases.items()]
        if len({name for name, _ in rows}) < len(rows):
            raise ValueError("an alias comes twice")
        return literal_rows(spark, rows, ALIASES)
    keyed = aliases.select(_key("alias").alias("alias"), "entity_id")
    if not keyed.groupBy("alias").count().where("count > 1").isEmpty():
        raise ValueError("an alias comes twice")
    return keyed


def _key(column: str) -> Column:
    return F.upper(F.trim(column))
