"""The nine reports as functions from DataFrames to a DataFrame.

The original queries leave some orders open (ties, name lists); here every tie
is broken by a key, and each docstring says how. Column names are parameters,
with the names of :mod:`callsheet.schemas` as defaults. Results are unsorted
unless the sort is the report.

Where a report looks up its few result rows in tables of any size, these rows
are written first: the joins are then planned with their true size, and a large
table is scanned next to a broadcast instead of being shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.functions import integer_average, joined_names, money_share, share_in_millions
from callsheet.operators.ranking import nth_row
from callsheet.session import materialise

MILLION = 1_000_000


def top_with_related(
    rollup: DataFrame,
    relations: DataFrame,
    entities: DataFrame,
    partitions: DataFrame | None = None,
    *,
    relatives: DataFrame | None = None,
    part: str = "part_id",
    entity: str = "entity_id",
    measure: str = "words",
    child: str = "apprentice_id",
    parent: str = "master_id",
    key: str = "id",
    name: str = "name",
    relative_key: str = "id",
    relative_name: str = "name",
    part_key: str = "part_id",
    part_name: str = "name",
    leading_blank: bool = True,
) -> DataFrame:
    """Per part the entities with the largest measure, and their related names.

    All entities that share the maximum are kept. Those without a relation are
    left out. The names are sorted and joined by ``', '`` behind a leading blank
    (``leading_blank=False`` drops it); a repeated relation repeats its name, an
    unknown name is skipped, and without any known name the list is NULL.
    ``relatives`` names the related side if it is not ``entities``.

    The maxima, a row per part, are written and join back on part and value, so
    the many rows of one large part are never gathered in one task. An entity's
    list is made once, however many parts it tops.
    """
    best = materialise(rollup.groupBy(part).agg(F.max(measure).alias(measure)), "best")
    tops = rollup.join(best, [part, measure]).select(
        F.col(part).alias("part_id"),
        F.col(entity).alias("entity_id"),
        F.col(measure).alias("words"),
    )
    tops = materialise(tops, "tops")
    edges = relations.where(F.col(parent).isNotNull()).select(
        F.col(child).alias("_child"), F.col(parent).alias("_parent")
    )
    relatives = entities if relatives is None else relatives
    known = relatives.select(
        F.col(relative_key).alias("_relative"), F.col(relative_name).alias("_relative_name")
    )
    named = entities.select(F.col(key).alias("_entity"), F.col(name).alias("entity_name"))
    lists = (
        tops.select("entity_id")
        .distinct()
        .join(edges, F.col("entity_id") == F.col("_child"))
        .join(known, F.col("_parent") == F.col("_relative"), "left")
        .groupBy("entity_id")
        .agg(joined_names(F.col("_relative_name"), leading_blank=leading_blank).alias("related"))
    )
    listed = tops.join(lists, "entity_id").join(named, F.col("entity_id") == F.col("_entity"))
    columns = ["part_id", "entity_id", "entity_name", "words", "related"]
    if partitions is not None:
        parts = partitions.select(
            F.col(part_key).alias("_part"), F.col(part_name).alias("part_name")
        )
        listed = listed.join(parts, F.col("part_id") == F.col("_part"), "left")
        columns.insert(1, "part_name")
    return listed.select(*columns)


def best_group(
    entities: DataFrame,
    locations: DataFrame | None = None,
    *,
    location: str = "location_id",
    score: str = "score",
    key: str = "id",
    name: str = "name",
    location_key: str = "id",
    location_name: str = "name",
) -> DataFrame:
    """One row: the location whose entities have the largest average score.

    The average is an integer cut toward zero; equal averages go to the
    smallest location id. Entities without a location, or with one missing in
    ``locations``, do not count. ``representative`` is the best entity of the
    whole table, not of that location (smallest id among equals).
    """
    groups = (
        entities.where(F.col(location).isNotNull())
        .groupBy(F.col(location).alias("location_id"))
        .agg(integer_average(F.col(score)).alias("average"), F.count(key).alias("members"))
    )
    columns = ["location_id", "average", "members", "representative"]
    if locations is not None:
        named = locations.select(
            F.col(location_key).alias("_location"), F.col(location_name).alias("location_name")
        )
        groups = groups.join(named, F.col("location_id") == F.col("_location"))
        columns.insert(1, "location_name")
    first = entities.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()).limit(1).select(name)
    return (
        groups.orderBy(F.col("average").desc_nulls_last(), F.col("location_id").asc())
        .limit(1)
        .withColumn("representative", first.scalar())
        .select(*columns)
    )


def average_share(
    entities: DataFrame,
    rollup: DataFrame,
    partitions: DataFrame,
    *,
    key: str = "id",
    name: str = "name",
    entity: str = "entity_id",
    part: str = "part_id",
    measure: str = "words",
    part_key: str = "part_id",
    total: str = "words_total",
    money: str = "money",
    truncate: bool = False,
) -> DataFrame:
    """Per entity its share of the money, averaged over all parts.

    A part in which an entity is silent counts as zero, and entities without
    any part are listed. The average therefore is the sum of the shares over
    the number of parts, and the parts x entities grid is never built. Needs
    one rollup row per entity and part. A part with a zero total is an error,
    silent or not; a part whose total or money is NULL does not count.
    ``truncate`` cuts the decimals of each share instead of rounding them.
    """
    partitions = partitions.where(F.col(part_key).isNotNull())
    silent_share = money_share(F.lit(0), F.col(total), F.col(money))
    parts = partitions.agg(F.nullif(F.count(silent_share), F.lit(0).cast("long"))).scalar()
    factors = partitions.select(
        F.col(part_key).alias("_part"), F.col(total).alias("_total"), F.col(money).alias("_money")
    )
    earned = (
        rollup.join(factors, F.col(part) == F.col("_part"))
        .groupBy(F.col(entity).alias("_earner"))
        .agg(
            F.sum(money_share(F.col(measure), F.col("_total"), F.col("_money"), truncate)).alias("_sum")
        )
    )
    average = F.coalesce(F.col("_sum"), F.lit(0).cast("decimal(38,6)")) / parts
    return entities.join(earned, F.col(key) == F.col("_earner"), "left").select(
        F.col(key).alias("entity_id"),
        F.col(name).alias("entity_name"),
        average.cast("decimal(38,6)").alias("average_share"),
    )


def extreme_share(
    rollup: DataFrame,
    partitions: DataFrame,
    entities: DataFrame,
    mode: str = "most",
    *,
    part: str = "part_id",
    entity: str = "entity_id",
    measure: str = "words",
    part_key: str = "part_id",
    part_name: str = "name",
    total: str = "words_total",
    money: str = "money",
    key: str = "id",
    name: str = "name",
    truncate: bool = False,
) -> DataFrame:
    """Per part the one entity with the most, or least, of its money in millions.

    Only entities that occur in a part are ranked, so the least is never one
    that is silent; equals go to the smallest id. A NULL measure comes first
    for the least and last for the most. A part whose winner, or which itself,
    is missing in the dimension is left out. ``truncate`` cuts the decimals of the
    worth instead of rounding them.

    Within a part the total is one constant, so rows are ranked by the measure;
    each map task keeps its best row per part and only the winners are joined.
    """
    orders = {"most": F.col(measure).desc_nulls_last(), "least": F.col(measure).asc_nulls_first()}
    if mode.lower() not in orders:
        raise ValueError(f"mode must be 'most' or 'least', not {mode!r}")
    ranking = Window.partitionBy(part).orderBy(orders[mode.lower()], F.col(entity).asc())
    winners = (
        rollup.withColumn("_rank", F.row_number().over(ranking))
        .where(F.col("_rank") == 1)
        .select(
            F.col(part).alias("part_id"),
            F.col(entity).alias("entity_id"),
            F.col(measure).alias("words"),
        )
    )
    winners = materialise(winners, "winners")
    parts = partitions.select(
        F.col(part_key).alias("_part"),
        F.col(part_name).alias("part_name"),
        F.col(total).alias("_total"),
        F.col(money).alias("_money"),
    )
    named = entities.select(F.col(key).alias("_entity"), F.col(name).alias("entity_name"))
    worth = share_in_millions(F.col("words"), F.col("_total"), F.col("_money"), truncate)
    return (
        winners.join(parts, F.col("part_id") == F.col("_part"))
        .join(named, F.col("entity_id") == F.col("_entity"))
        .select(
            "part_id",
            "part_name",
            "entity_id",
            "entity_name",
            worth.alias("worth_in_millions"),
        )
    )


def pair_totals(
    turns: DataFrame,
    entities: DataFrame | None = None,
    *,
    texts: DataFrame | None = None,
    source: str = "from_id",
    target: str = "to_id",
    words: str = "word_count",
    turn: str | Sequence[str] = "id",
    text: str | None = "text",
    key: str = "id",
    name: str = "name",
) -> DataFrame:
    """Words per undirected pair, and the text of the pair's longest turn.

    Self pairs count; turns without a target do not. ``hi_id`` is the larger
    id. Of equally long turns the one with the smallest id is the example;
    ``text=None`` gives that id itself. The id may be several columns, compared
    in their order. Two texts under one id are an error. With ``entities`` the names are added
    and pairs of unknown entities left out.

    Turns are first folded per pair and length, then per pair, over numbers
    alone. Only then are the texts of the chosen turns looked up by their id,
    so no text is sorted, shuffled or kept for a turn that is not an example.
    ``texts`` is the table that holds them, if it is not ``turns``.
    """
    length = F.col("_length")
    key_of_turn = F.col(turn) if isinstance(turn, str) else F.struct(*turn)
    pairs = (
        turns.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(
            F.greatest(source, target).alias("hi_id"),
            F.least(source, target).alias("lo_id"),
            F.col(words).alias("_length"),
        )
        .agg(F.sum(words).alias("_words"), F.min(key_of_turn).alias("_turn"))
        .groupBy("hi_id", "lo_id")
        .agg(
            F.sum("_words").alias("words"),
            F.min_by("_turn", F.struct(length.isNull(), -length)).alias("example"),
        )
    )
    columns = ["hi_id", "lo_id", "words", "example"]
    if text is not None:
        pairs = materialise(pairs.withColumnRenamed("example", "_example"), "pairs")
        texts = turns if texts is None else texts
        texts = texts.select(key_of_turn.alias("_turn"), F.col(text).alias("example"))
        met = pairs.join(texts, F.col("_example") == F.col("_turn"))
        twice = F.raise_error(F.lit("a turn id has several texts"))
        pairs = met.groupBy("hi_id", "lo_id", "words").agg(
            F.when(F.count("*") > 1, twice).otherwise(F.first("example")).alias("example")
        )
    if entities is not None:
        hi = entities.select(F.col(key).alias("_hi"), F.col(name).alias("hi_name"))
        lo = entities.select(F.col(key).alias("_lo"), F.col(name).alias("lo_name"))
        pairs = pairs.join(hi, F.col("hi_id") == F.col("_hi")).join(
            lo, F.col("lo_id") == F.col("_lo")
        )
        columns[2:2] = ["hi_name", "lo_name"]
    return pairs.select(*columns)


def flag_wins(
    contests: DataFrame,
    entities: DataFrame,
    flag: str,
    *,
    first: str = "first_id",
    second: str = "second_id",
    outcome: str = "outcome",
    key: str = "id",
    winner_aware: bool = False,
    into: str = "wins",
) -> DataFrame:
    """Decided contests between entities whose flags differ, per winning flag.

    By default a contest counts for the first entity's flag whenever it has an
    outcome, whichever that is. ``winner_aware=True`` reads the outcome: true
    for the first, false for the second. Flags must both be known; a flag
    without a win has no row.

    Contests are counted per pairing before the flags are looked up, so a much
    repeated pairing or entity reaches the joins as a few rows.
    """
    pairings = (
        contests.where(F.col(outcome).isNotNull())
        .groupBy(
            F.col(first).alias("_first"),
            F.col(second).alias("_second"),
            F.col(outcome).alias("_won"),
        )
        .agg(F.count("*").alias("_contests"))
    )
    flags = entities.where(F.col(flag).isNotNull())
    firsts = flags.select(F.col(key).alias("_first_key"), F.col(flag).alias("_first_flag"))
    seconds = flags.select(F.col(key).alias("_second_key"), F.col(flag).alias("_second_flag"))
    winner = F.col("_first_flag")
    if winner_aware:
        winner = F.when(F.col("_won"), winner).otherwise(F.col("_second_flag"))
    return (
        pairings.join(firsts, F.col("_first") == F.col("_first_key"))
        .join(seconds, F.col("_second") == F.col("_second_key"))
        .where(F.col("_first_flag") != F.col("_second_flag"))
        .groupBy(winner.alias(flag))
        .agg(F.sum("_contests").alias(into))
    )


def nth_ranked(
    entities: DataFrame,
    rollup: DataFrame,
    part_value: object,
    n: int | None,
    *,
    part: str = "part_id",
    entity: str = "entity_id",
    key: str = "id",
    score: str = "score",
    into: str = "rank",
) -> DataFrame:
    """The entity with the n-th largest score among those in a part.

    All columns of both tables, and the rank. Equals are ranked by id, NULL
    scores last. A rank that does not exist, or NULL, gives no row.

    One plan for every n, :func:`nth_row`: scores are counted by ranges, so the
    part is neither sorted across tasks nor written. Only the row found is looked
    up for the other columns.
    """
    scores = entities.select(F.col(key).alias("_key"), F.col(score).alias("_score"))
    present = rollup.where(F.col(part) == F.lit(part_value)).join(
        scores, F.col(entity) == F.col("_key")
    )
    found = nth_row(present, [("_score", True), ("_key", False)], n)
    found = found.select(*present.columns, F.lit(n).cast("int").alias(into))
    return entities.join(found, F.col(key) == F.col("_key")).select(
        *[entities[c] for c in entities.columns], *[found[c] for c in rollup.columns], into
    )
