"""The operators bound to the given tables, with an equal SQL text for each.

Stand-ins for the dialogue tables:

* turns between entities: line items, from the supplier's nation to the
  customer's nation, measured by quantity (``_flow``);
* rollup: orders per customer and order priority, the priorities being the
  parts, with their order count as total and their revenue in cents as money;
* texts: documents and conversations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

import oracle_queries
from callsheet.functions import register_functions, word_count
from callsheet.operators import (
    accept_pairs,
    breaking_rows,
    column_violations,
    coverage,
    delete_rows,
    dense_ids,
    duplicate_keys,
    entity_rollup,
    fill_defaults,
    integrity_report,
    nth_row,
    orphan_keys,
    orphans,
    orphans_by_bitmap,
    pair_rollup,
    refusals,
    rows_with_violations,
    split_pairs,
    uncovered,
    update_from,
    with_word_count,
)
from callsheet.plans import (
    REPORTS,
    Snapshots,
    average_share,
    best_group,
    create_views,
    derive,
    extreme_share,
    flag_wins,
    nth_ranked,
    pair_totals,
    top_with_related,
)
from callsheet.schemas import CASCADE, REFUSE, SET_NULL, ForeignKey, TableRules
from callsheet.session import materialise, workspace
from callsheet.sources import (
    StoredRollup,
    append_numbered,
    append_rows,
    delete_in_files,
    escaped,
    names_with_fragments,
    read_table,
    read_transcript_source,
    read_transcripts,
    replace_table,
    speaker_words,
    to_turns,
    unlisted,
    update_partitions,
)

# The numbered queries and the pipeline can be taken away; all else stays.
try:
    from callsheet.llm import queries as llm_queries
except ModuleNotFoundError as error:
    if error.name not in {"callsheet.llm", "corpus_pipeline"}:
        raise
    llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
    " c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", StructType.fromDDL(SCHEMAS[name]))


# --- stand-in facts ---------------------------------------------------------


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as turns: supplier nation -> customer nation, quantity."""
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_returnflag",
        F.col("l_quantity").cast("long").alias("qty"),
    )
    sources = _table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("from_id")
    )
    targets = (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.col("c_nationkey").alias("to_id"))
    )
    return lines.join(sources, F.col("l_suppkey") == F.col("s_suppkey")).join(
        targets, F.col("l_orderkey") == F.col("o_orderkey")
    )


def _flow_with_open_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir).withColumn("to_id", F.nullif("to_id", F.lit(0)))


def _order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup: orders per customer (entity) and priority (part)."""
    return (
        _table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("part_id"))
        .agg(F.count("*").alias("words"))
    )


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: the priorities with order count and revenue in cents, as a stored table."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    parts = (
        _table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("part_id"))
        .agg(F.count("*").alias("words_total"), F.sum(cents).alias("money"))
        .withColumn("name", F.col("part_id"))
    )
    return materialise(parts, "priorities")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("score"),
        F.col("c_nationkey").alias("location_id"),
    )


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey"
    )


# --- sources and sinks ------------------------------------------------------


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select("l_orderkey", "l_linenumber", "l_partkey")
    )


def _words_by(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(F.col(column).alias("word_group")).agg(
        F.sum(word_count(F.col("text"))).alias("words")
    )


def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a rollup as a table partitioned by language; read it back."""
    path = f"{workspace(spark)}/stored-rollup-{uuid.uuid4().hex}"
    return replace_table(text_rollup(spark, sf_dir), path, ["lang"])


def self_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the words per source, then keep of the stored table what it says."""
    path = f"{workspace(spark)}/self-replaced-{uuid.uuid4().hex}"
    stored = replace_table(_words_by(spark, sf_dir, "source"), path)
    return replace_table(stored.where(F.col("words") % 2 == 0), path)


def appended_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number the conversations' turns in two loads with ids that go on."""
    path = f"{workspace(spark)}/appended-ids-{uuid.uuid4().hex}"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    for rest in (0, 1):
        load = turns.where(F.col("conv_id") % 2 == rest)
        append_numbered(load, path, ["conv_id", "turn"], into="dialogue_id")
    return spark.read.parquet(path)


def appended_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the words per source to the words per language."""
    path = f"{workspace(spark)}/appended-rollups-{uuid.uuid4().hex}"
    by_lang = _words_by(spark, sf_dir, "lang")
    replace_table(by_lang, path)
    append_rows(_words_by(spark, sf_dir, "source"), path)
    return read_table(spark, path, by_lang.schema)


ROLE_IDS = {"USER": 0, "ASSISTANT": 1, "SYSTEM": 1}


def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    return _table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        (F.col("turn") % 2 + 1).cast("int").alias("source_part"),
        role.alias("speaker"),
        F.when(role == "user", " assistant").when(role == "assistant", "User").alias("addressee"),
        "text",
    )


def ingest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = to_turns(_transcript(spark, sf_dir), ROLE_IDS, part_map={1: 4, 2: 5})
    return turns.select(
        "conv_id",
        "turn",
        F.col("part_id").cast("int").alias("part_id"),
        "from_id",
        "to_id",
        "word_count",
    )


def _written_transcripts(spark: SparkSession, sf_dir: str, text: Column) -> str:
    path = f"{workspace(spark)}/transcripts-{uuid.uuid4().hex}"
    target = F.concat(F.lit(" (to "), F.trim("addressee"), F.lit(")"))
    lines = _transcript(spark, sf_dir).select(
        "source_part",
        F.concat("speaker", F.coalesce(target, F.lit("")), F.lit(": "), text).alias("value"),
    )
    lines.write.partitionBy("source_part").text(path)
    return path


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the conversations as transcript text files, then ingest the files."""
    path = _written_transcripts(spark, sf_dir, escaped(F.col("text")))
    found, _ = read_transcripts(spark, path, part_pattern=r"source_part=(\d+)", escapes=True)
    turns = to_turns(found, ROLE_IDS, part_map={1: 4, 2: 5})
    return turns.groupBy(F.col("part_id").cast("int").alias("part_id"), "from_id", "to_id").agg(
        F.count("*").alias("turns"), F.sum("word_count").alias("words")
    )


def transcript_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``transcript_files``, read by the data source in splits of 20,000 bytes."""
    path = _written_transcripts(spark, sf_dir, escaped(F.col("text")))
    found, _ = read_transcript_source(
        spark, path, part_pattern=r"source_part=(\d+)", escapes=True, split_bytes=20_000
    )
    turns = to_turns(found, ROLE_IDS, part_map={1: 4, 2: 5})
    return turns.groupBy(F.col("part_id").cast("int").alias("part_id"), "from_id", "to_id").agg(
        F.count("*").alias("turns"), F.sum("word_count").alias("words")
    )


def transcript_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an ingest of the texts as they are accepts, and rejects by reason.

    A blank line is put before each turn, and the system's turns have no listed
    speaker. Line breaks in the texts make continuation lines.
    """
    text = F.translate("text", ":()[]\r", "      ")
    paragraphs = F.concat(F.regexp_replace(text, "\n+", "\n"), F.lit("\n"))
    path = _written_transcripts(spark, sf_dir, F.concat(F.lit("- "), paragraphs, F.lit("[pause]")))
    found, rejects = read_transcripts(spark, path, part_pattern=r"source_part=(\d+)")
    listed = {name: entity for name, entity in ROLE_IDS.items() if name != "SYSTEM"}
    lines = found.withColumn("reject", F.lit("accepted"))
    strange = unlisted(found, listed).withColumn("reject", F.lit("unlisted speaker"))
    known = to_turns(lines.withColumn("n", F.col("n_lines")), listed, part_map={1: 4, 2: 5})
    counted = known.groupBy("reject").agg(F.sum("n").alias("n"))
    return counted.union(strange.groupBy("reject").agg(F.sum("n_lines").alias("n"))).union(
        rejects.groupBy("reject").agg(F.count("*").alias("n"))
    )


def speaker_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_words(_transcript(spark, sf_dir), ["SYS", "assist"], parts=[1, 2])


# --- derivations ------------------------------------------------------------


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        "doc_id", word_count(F.col("text")).alias("words")
    )


def sql_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return spark.sql(
        "SELECT conv_id, turn, word_count(text) AS words FROM {turns}",
        turns=_table(spark, sf_dir, "conversations"),
    )


def text_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_word_count(_table(spark, sf_dir, "documents"))
    return entity_rollup(docs, entity="lang", part="source")


def turn_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_word_count(_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "word_count")


def dim_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").withColumn("rich_suppliers", F.lit(-1).cast("long"))
    counts = (
        _table(spark, sf_dir, "supplier")
        .where(F.col("s_acctbal") > 8000)
        .groupBy("s_nationkey")
        .agg(F.count("*").alias("n"))
    )
    return update_from(nations, "n_nationkey", counts, "s_nationkey", "rich_suppliers", "n")


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_rollup(_flow(spark, sf_dir), words="qty")


def pair_stats_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_rollup(_flow_with_open_targets(spark, sf_dir), words="qty")


def pair_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept_pairs(pair_stats(spark, sf_dir), mode="strict")


def pair_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(pair_stats_nulls(spark, sf_dir))[1]


def pair_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept_pairs(pair_stats_nulls(spark, sf_dir), mode="quarantine")


# --- reports ----------------------------------------------------------------


def top_region_with_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority the region with most orders, and the names of its nations."""
    nations = _nations(spark, sf_dir)
    regions = nations.select(F.col("id").alias("nation"), "n_regionkey")
    homes = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    folded = _order_counts(spark, sf_dir)  # before the joins, so orders reach them as counts
    rollup = (
        folded.join(homes, F.col("entity_id") == F.col("c_custkey"))
        .join(regions, F.col("c_nationkey") == F.col("nation"))
        .groupBy("part_id", F.col("n_regionkey").alias("entity_id"))
        .agg(F.sum("words").alias("words"))
    )
    return top_with_related(
        rollup,
        nations.select(F.col("n_regionkey").alias("apprentice_id"), F.col("id").alias("master_id")),
        _table(spark, sf_dir, "region"),
        relatives=nations,
        key="r_regionkey",
        name="r_name",
    )


def best_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_group(
        _table(spark, sf_dir, "part"),
        location="p_brand",
        score="p_size",
        key="p_partkey",
        name="p_name",
    )


def best_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number balances, some of them negative, per nation."""
    customers = _customers(spark, sf_dir).withColumn("score", F.col("score").cast("long"))
    return best_group(customers, _nations(spark, sf_dir))


def avg_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = average_share(
        _customers(spark, sf_dir), _order_counts(spark, sf_dir), _priorities(spark, sf_dir)
    )
    return shares.withColumn("average_share", F.col("average_share").cast("double"))


def _extreme(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts, people = _priorities(spark, sf_dir), _customers(spark, sf_dir)
        found = extreme_share(_order_counts(spark, sf_dir), parts, people, mode)
        return found.withColumn("worth_in_millions", F.col("worth_in_millions").cast("double"))

    return run


def most_share_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most of each part's money, with decimals cut as the original does."""
    parts, people = _priorities(spark, sf_dir), _customers(spark, sf_dir)
    found = extreme_share(_order_counts(spark, sf_dir), parts, people, "most", truncate=True)
    return found.withColumn("worth_in_millions", F.col("worth_in_millions").cast("double"))


def avg_share_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each customer's shares, each cut at six decimals, over the parts."""
    shares = average_share(
        _customers(spark, sf_dir), _order_counts(spark, sf_dir), _priorities(spark, sf_dir), truncate=True
    )
    return shares.withColumn("average_share", F.col("average_share").cast("double"))


def most_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the source with most words, as a share of the language's characters."""
    docs = _table(spark, sf_dir, "documents")
    rollup = materialise(
        docs.groupBy(F.col("source").alias("entity_id"), F.col("lang").alias("part_id")).agg(
            F.sum(word_count(F.col("text"))).alias("words"), F.sum("n_chars").alias("chars")
        ),
        "most-words",
    )
    langs = rollup.groupBy("part_id").agg(
        F.sum("words").alias("words_total"), F.sum("chars").alias("money")
    )
    sources = rollup.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("name"))
    found = extreme_share(rollup, langs, sources.distinct(), part_name="part_id")
    return found.select(
        "part_id", "entity_id", F.col("worth_in_millions").cast("double").alias("worth_in_millions")
    )


def pair_totals_with_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_totals(
        _flow(spark, sf_dir), words="qty", turn="l_orderkey", text=None
    )


def pair_totals_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _flow_with_open_targets(spark, sf_dir)
    return pair_totals(
        turns, _nations(spark, sf_dir), words="qty", turn="l_orderkey", text=None
    )


def pair_totals_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest line of each pair. Order and line number repeat in the given
    table, so the key takes the part, the supplier and the date as well."""
    return pair_totals(
        _flow(spark, sf_dir),
        texts=_table(spark, sf_dir, "lineitem"),
        words="qty",
        turn=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"),
        text="l_returnflag",
    )


def longest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between the roles of the conversations, with the longest line."""
    turns = to_turns(_transcript(spark, sf_dir), ROLE_IDS)
    return pair_totals(turns, turn=("conv_id", "turn"))


def _wins(winner_aware: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        letter = F.col("l_returnflag")
        outcome = F.when(letter == "A", True).when(letter == "R", False)
        region = F.col("n_regionkey")
        nations = _nations(spark, sf_dir).withColumn("flag", F.when(region != 0, region == 1))
        return flag_wins(
            _flow(spark, sf_dir).withColumn("outcome", outcome),
            nations,
            "flag",
            first="from_id",
            second="to_id",
            winner_aware=winner_aware,
        )

    return run


def _ranked(n: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = nth_ranked(_customers(spark, sf_dir), _order_counts(spark, sf_dir), "5-LOW", n)
        return found.select("id", "name", "part_id", "words", "rank")

    return run


def pair_totals_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair report as a SQL view, read by SQL with a parameter."""
    found = {"pair_totals": pair_totals_named(spark, sf_dir)}
    create_views({"entity": _nations(spark, sf_dir)}, found)
    return spark.sql(
        """
        SELECT hi_name AS name, words, example
        FROM report_pair_totals JOIN entity ON hi_id = id
        WHERE hi_id = lo_id AND n_regionkey <> :region
        """,
        args={"region": 0},
    )


def _with_report_functions(spark: SparkSession, sf_dir: str) -> None:
    tables = {
        "entity": _customers(spark, sf_dir),
        "partition": _priorities(spark, sf_dir),
        "rollup": _order_counts(spark, sf_dir),
    }
    create_views(tables, {})


def sql_extreme_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes of the share report, called from SQL as a table function."""
    _with_report_functions(spark, sf_dir)
    return spark.sql(
        """
        SELECT mode, part_id, entity_id, entity_name,
               CAST(worth_in_millions AS DOUBLE) AS worth_in_millions
        FROM (SELECT 'most' AS mode, * FROM extreme_share('MOST')
              UNION ALL SELECT 'least', * FROM extreme_share('least'))
        """
    )


def sql_nth_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second, tenth and a missing rank of one part, called from SQL."""
    _with_report_functions(spark, sf_dir)
    return spark.sql(
        """
        SELECT * FROM nth_ranked('5-LOW', 2) UNION ALL SELECT * FROM nth_ranked('5-LOW', 10)
        UNION ALL SELECT * FROM nth_ranked('5-LOW', 1000000000)
        """
    )


# --- the whole workload -----------------------------------------------------


def _workload(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Six base tables for the whole workload: nations talk in the conversations."""
    nation = _table(spark, sf_dir, "nation")
    region, key = F.col("n_regionkey"), F.col("n_nationkey")
    conv, turn, balance = F.col("conv_id"), F.col("turn"), F.col("s_acctbal")
    turns = _table(spark, sf_dir, "conversations").select(
        F.struct(conv.alias("conv"), turn.alias("turn")).alias("id"),
        (turn % 3 + 4).cast("int").alias("part_id"),
        (conv % 25).cast("int").alias("from_id"),
        F.nullif(((conv + turn) % 25).cast("int"), F.lit(24)).alias("to_id"),
        "text",
    )
    spoken = with_word_count(turns).groupBy("part_id")
    return {
        "partition": spoken.agg(
            (F.sum("word_count") + 7).alias("words_total"),
            (F.count("*") * 1_000_003).alias("money"),
            F.lit(None).cast("long").alias("words_known"),
        ).withColumn("name", F.concat(F.lit("part "), "part_id")),
        "location": _table(spark, sf_dir, "region").toDF("id", "name"),
        "entity": nation.select(
            key.alias("id"),
            F.col("n_name").alias("name"),
            (key * 37 % 11).alias("score"),
            F.when(region != 0, region == 1).alias("flag_a"),
            F.nullif(region, F.lit(4)).alias("location_id"),
            (key % 2 == 0).alias("flag_b"),
        ),
        "turn": turns,
        "relation": nation.where(region != key).select(
            region.alias("master_id"), key.alias("apprentice_id")
        ),
        "contest": _table(spark, sf_dir, "supplier").select(
            F.col("s_nationkey").alias("first_id"),
            (F.col("s_suppkey") % 25).cast("int").alias("second_id"),
            F.when(balance > 5000, True).when(balance < 1000, False).alias("outcome"),
        ),
    }


def _derived(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derive(_workload(spark, sf_dir), pair_mode="quarantine")[name]

    return run


def _report(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = REPORTS[name](derive(_workload(spark, sf_dir), pair_mode="quarantine"))
        if "worth_in_millions" in found.columns:
            worth = F.col("worth_in_millions").cast("double")
            found = found.withColumn("worth_in_millions", worth)
        return found

    return run


def workload_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = derive(_workload(spark, sf_dir), pair_mode="quarantine")
    return nth_ranked(tables["entity"], tables["rollup"], 5, 3)


# --- quality, keys, deletes -------------------------------------------------


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    solvent = _table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orphans(orders, "o_custkey", solvent, "c_custkey")


def null_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rows_with_violations(docs, ["text", "lang"], {"text": 586}).select("doc_id")


def null_length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return column_violations(docs, ["text", "lang"], {"text": 586, "source": 20})


def predicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = breaking_rows(_flow(spark, sf_dir), F.col("from_id") != F.col("to_id"))
    return bad.select("l_orderkey", "l_linenumber", "from_id", "to_id", "qty")


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(
        _table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "labels"), "doc_id"
    )


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return uncovered(documents, "doc_id", _table(spark, sf_dir, "labels"), "doc_id")


DRIVER_RULES = {
    "nation": TableRules(
        StructType().add("n_nationkey", "integer", False).add("n_name", "string", False),
        primary_key=("n_nationkey",),
        unique=(("n_name",), ("n_regionkey",)),
        max_length={"n_name": 8},
    ),
    "customer": TableRules(
        StructType().add("c_custkey", "long", False),
        primary_key=("c_custkey",),
        checks={"balance is not negative": "c_acctbal >= 0"},
    ),
    "orders": TableRules(StructType(), primary_key=("o_orderkey",)),
    "lineitem": TableRules(
        StructType().add("l_orderkey", "long", False).add("l_quantity", "double", False),
        primary_key=("l_orderkey", "l_linenumber"),
        checks={"discount below 8 percent": "l_discount < 0.08"},
    ),
    "labels": TableRules(StructType(), unique=(("doc_id",),)),
    "documents": TableRules(StructType(), max_length={"text": 586}),
}
DRIVER_KEYS = (
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("documents", "doc_id", "labels", "doc_id"),
)


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: _table(spark, sf_dir, name) for name in DRIVER_RULES}
    return integrity_report(tables, DRIVER_RULES, DRIVER_KEYS)


def _first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.regexp_extract("text", "^[^ \\n\\t]+", 0)
    return _table(spark, sf_dir, "documents").select(first.alias("word")).where("word <> ''")


def dup_words_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents that come twice, in any case."""
    return duplicate_keys(_first_words(spark, sf_dir), ["word"], collation="UTF8_LCASE")


def orphans_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents that no conversation has for its first, in any case."""
    spoken = _table(spark, sf_dir, "conversations").select(
        F.lower(F.regexp_extract("text", "^[^ \\n\\t]+", 0)).alias("spoken")
    )
    return orphans(_first_words(spark, sf_dir), "word", spoken.distinct(), "spoken", "UTF8_LCASE")


def name_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers whose name holds the last four characters of a supplier's."""
    names = _table(spark, sf_dir, "customer").select("c_name")
    fragments = _table(spark, sf_dir, "supplier").select(F.right("s_name", F.lit(4)).alias("fragment"))
    return names_with_fragments(names, fragments)


def refreshed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation and region as stored views; only what changed is made anew."""
    path = _scratch(spark, "views")
    nations = f"{path}/base-nation"
    replace_table(_table(spark, sf_dir, "nation"), nations)
    views = (
        Snapshots(spark, path)
        .table("customer", f"{sf_dir}/customer.parquet", StructType.fromDDL(SCHEMAS["customer"]))
        .table("nation", nations, StructType.fromDDL(SCHEMAS["nation"]))
        .view(
            "per_nation",
            ["customer"],
            lambda t: t["customer"].groupBy("c_nationkey").agg(F.count("*").alias("customers")),
        )
        .view(
            "per_region",
            ["per_nation", "nation"],
            lambda t: t["per_nation"]
            .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_regionkey")
            .agg(F.sum("customers").alias("customers")),
        )
    )
    views.refresh()
    # two nations change sides: the view over customers alone is left as it is
    moved = F.when(F.col("n_nationkey") < 2, F.lit(4)).otherwise(F.col("n_regionkey"))
    replace_table(_table(spark, sf_dir, "nation").withColumn("n_regionkey", moved), nations)
    again = views.refresh()
    return views.read("per_region").withColumn("made_again", F.lit(",".join(again)))


def _priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= 20000)


def lost_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order keys of line items whose order is not among those that cost enough."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey")
    return orphan_keys(lines, "l_orderkey", _priced_orders(spark, sf_dir), "o_orderkey")


def lost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return orphans_by_bitmap(lines, "l_orderkey", _priced_orders(spark, sf_dir), "o_orderkey")


# --- stored tables that change in part ---------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def folded_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per supplier and flag, from line items that come in three batches;
    the second one comes twice."""
    stored = StoredRollup(
        spark, _scratch(spark, "folded"), ["l_suppkey", "l_returnflag"], "qty", buckets=4
    )
    lines = _table(spark, sf_dir, "lineitem").withColumn("qty", F.col("l_quantity").cast("long"))
    year = F.year("l_shipdate")
    for name, batch in (("old", year < 1995), ("new", year >= 1995), ("new", year >= 1995)):
        stored.fold(lines.where(batch), name)
    stored.fold(lines.where(year.isNull()), "undated")
    return stored.read()


def folded_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per role, with the longest turn, from conversations in two batches."""
    stored = StoredRollup(
        spark, _scratch(spark, "folded"), ["role"], turn=("conv_id", "turn"), buckets=2
    )
    turns = with_word_count(_table(spark, sf_dir, "conversations"))
    for name, batch in (("openings", F.col("turn") == 0), ("rest", F.col("turn") != 0)):
        stored.fold(turns.where(batch), name)
    return stored.read().select(
        "role", "words", "turns", F.col("longest.conv_id").alias("conv_id"), F.col("longest.turn").alias("turn")
    )


def updated_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored by segment; those of one segment get their number of orders."""
    path = _scratch(spark, "customers")
    customers = _table(spark, sf_dir, "customer")
    replace_table(customers, path, ["c_mktsegment"])
    buyers = customers.where(F.col("c_mktsegment") == "BUILDING")
    counts = (
        _table(spark, sf_dir, "orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_custkey")
        .agg(F.count("*").cast("double").alias("orders"))
    )
    schema = StructType.fromDDL(SCHEMAS["customer"])
    update_partitions(
        spark, path, schema, ["c_mktsegment"], "c_custkey", counts, "o_custkey", "c_acctbal", "orders"
    )
    return read_table(spark, path, schema)


def deleted_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored by customer, without those of the suppliers' namesakes in debt."""
    path = _scratch(spark, "orders")
    schema = StructType.fromDDL(SCHEMAS["orders"])
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    stored = StructType([schema[c] for c in orders.columns])
    orders.repartitionByRange(16, "o_custkey").write.parquet(path)
    debtors = _table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey")
    delete_in_files(spark, path, stored, "o_custkey", debtors)
    return read_table(spark, path, stored)


def dearest_line(n: int) -> Query:
    """The n-th dearest line item, over the whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _table(spark, sf_dir, "lineitem")
        order = [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False)]
        return nth_row(lines, order, n).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")

    return run


def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return dense_ids(customers, ["c_mktsegment", "c_custkey"], into="dense_id")


def _after_delete(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Delete region 0: nations and suppliers go too, customers lose the nation."""
    tables = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer")}
    links = [
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey", CASCADE),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", CASCADE),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", SET_NULL),
    ]
    return delete_rows(tables, links, "region", F.col("r_regionkey") == 0)


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_delete(spark, sf_dir)["nation"]


def cascade_second_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_delete(spark, sf_dir)["supplier"].select("s_suppkey", "s_nationkey")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that keep region 0 from being deleted with its nations."""
    tables = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer")}
    links = [
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey", CASCADE),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", REFUSE),
    ]
    found = refusals(tables, links, "region", F.col("r_regionkey") == 0)
    return found["customer"].select("c_custkey", "c_nationkey")


def set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_delete(spark, sf_dir)["customer"].select("c_custkey", "c_nationkey")


def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation")
    schema = StructType.fromDDL(SCHEMAS["nation"])
    schema.add("n_moons", IntegerType()).add("n_comment", StringType())
    return fill_defaults(nations, schema, {"n_moons": 1})


# --- the driver's three functions -------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Who has the most words per part: text, rollup, ranking, share, join."""
    return most_words(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    numbered = llm_queries.queries() if llm_queries else {}
    return {
        "table_scan": table_scan,
        "stored_rollup": stored_rollup,
        "self_replaced": self_replaced,
        "appended_rollups": appended_rollups,
        "appended_ids": appended_ids,
        "ingest_turns": ingest_turns,
        "transcript_files": transcript_files,
        "transcript_splits": transcript_splits,
        "transcript_rejects": transcript_rejects,
        "speaker_words": speaker_word_totals,
        "word_count": word_counts,
        "sql_word_count": sql_word_counts,
        "text_rollup": text_rollup,
        "turn_update": turn_update,
        "dim_update": dim_update,
        "pair_stats": pair_stats,
        "pair_stats_nulls": pair_stats_nulls,
        "pair_strict": pair_strict,
        "pair_quarantine": pair_quarantine,
        "pair_accepted": pair_accepted,
        "top_with_related": top_region_with_nations,
        "best_group": best_brand,
        "best_group_located": best_nation,
        "avg_share": avg_share,
        "most_share": _extreme("most"),
        "least_share": _extreme("LEAST"),
        "most_share_truncated": most_share_truncated,
        "avg_share_truncated": avg_share_truncated,
        "most_words": most_words,
        "pair_totals": pair_totals_with_example,
        "pair_totals_named": pair_totals_named,
        "pair_totals_text": pair_totals_text,
        "longest_lines": longest_lines,
        "flag_wins": _wins(winner_aware=False),
        "flag_wins_winner_aware": _wins(winner_aware=True),
        "nth_ranked": _ranked(2),
        "nth_ranked_late": _ranked(150),
        "nth_ranked_empty": _ranked(1_000_000_000),
        "pair_totals_view": pair_totals_view,
        "sql_extreme_shares": sql_extreme_shares,
        "sql_nth_ranked": sql_nth_ranked,
        "workload_rollup": _derived("rollup"),
        "workload_pairs": _derived("pair"),
        "workload_partitions": _derived("partition"),
        **{f"workload_{name}": _report(name) for name in REPORTS},
        "workload_nth_ranked": workload_nth,
        "nth_line": dearest_line(1),
        "nth_line_late": dearest_line(5000),
        "folded_rollup": folded_rollup,
        "folded_speakers": folded_speakers,
        "updated_partitions": updated_partitions,
        "deleted_in_files": deleted_in_files,
        "refreshed_views": refreshed_views,
        "name_fragments": name_fragments,
        "dup_words_collated": dup_words_collated,
        "orphans_collated": orphans_collated,
        "orphan_keys": lost_keys,
        "orphans_by_bitmap": lost_lines,
        "dup_keys": dup_keys,
        "orphans": orphan_orders,
        "null_length_check": null_length_check,
        "null_length_counts": null_length_counts,
        "predicate_check": predicate_check,
        "coverage": label_coverage,
        "uncovered": unlabelled,
        "integrity_report": integrity,
        "dense_ids": customer_ids,
        "cascade": cascade,
        "cascade_second_level": cascade_second_level,
        "refused": refused,
        "set_null": set_null,
        "defaults": defaults,
        **numbered,
    }


def oracle_sql() -> dict[str, str]:
    """For each query the equal SQL text for DuckDB; see ``oracle_queries``."""
    numbered = llm_queries.oracle_sql() if llm_queries else {}
    return {**oracle_queries.sql_texts(), **numbered}
