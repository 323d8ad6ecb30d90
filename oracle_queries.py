"""SQL texts for DuckDB, one per registered query, over the same tables.

They are written apart from the operators and take other ways where they can:
windows instead of folds, the full grid for the average over all parts, and
integers for fixed-point shares.
"""

from __future__ import annotations

WORDS = "length(rtrim(text, ' ')) - length(replace(text, ' ', '')) + 1"
FLOW = """
    flow AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag,
               s_nationkey AS from_id,
               c_nationkey AS to_id, CAST(l_quantity AS BIGINT) AS qty
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey
    )"""
OPEN_FLOW = FLOW.replace("c_nationkey AS to_id", "nullif(c_nationkey, 0) AS to_id")
# Shares as exact integers: the ratio in units of 10^-12, the share of 10^-6.
SHARES = """
    parts AS (
        SELECT o_orderpriority AS part_id, count(*) AS total,
               sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS money
        FROM orders GROUP BY 1
    ),
    rollup_rows AS (
        SELECT o_custkey AS entity_id, o_orderpriority AS part_id, count(*) AS n
        FROM orders GROUP BY 1, 2
    ),
    shares AS (
        SELECT entity_id, part_id, n,
               (CAST((2 * CAST(n AS HUGEINT) * 1000000000000 + total) // (2 * total) AS HUGEINT)
                * money + 500000) // 1000000 AS share6
        FROM rollup_rows JOIN parts USING (part_id)
    )"""

ROUNDED = """(CAST((2 * CAST(n AS HUGEINT) * 1000000000000 + total) // (2 * total) AS HUGEINT)
                * money + 500000) // 1000000 AS share6"""
TRUNCATED = """(CAST(n AS HUGEINT) * 1000000000000 // total) * money // 1000000 AS share6"""
FIRST_WORDS = "SELECT regexp_extract(text, '^[^ \\n\\t]+') AS word FROM {}"


def _extreme_sql(order: str) -> str:
    return f"""
    WITH {SHARES},
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY n {order}, entity_id) AS rn
        FROM shares
    )
    SELECT part_id, part_id AS part_name, entity_id, c_name AS entity_name,
           CAST((2 * share6 + 1000000) // 2000000 AS DOUBLE) / 1000000 AS worth_in_millions
    FROM ranked JOIN customer ON c_custkey = entity_id WHERE rn = 1"""


def _nth_line_sql(n: int) -> str:
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey
    LIMIT 1 OFFSET {n - 1}"""


def _pair_totals_sql(flow: str, names: bool) -> str:
    columns, joins = "", ""
    if names:
        columns = "a.n_name AS hi_name, b.n_name AS lo_name,"
        joins = "JOIN nation a ON a.n_nationkey = hi_id JOIN nation b ON b.n_nationkey = lo_id"
    return f"""
    WITH {flow},
    turns AS (
        SELECT CASE WHEN from_id > to_id THEN from_id ELSE to_id END AS hi_id,
               CASE WHEN from_id > to_id THEN to_id ELSE from_id END AS lo_id,
               qty, l_orderkey
        FROM flow WHERE to_id IS NOT NULL
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY hi_id, lo_id ORDER BY qty DESC, l_orderkey) AS rn
        FROM turns
    )
    SELECT hi_id, lo_id, {columns} CAST(sum(qty) AS BIGINT) AS words,
           max(CASE WHEN rn = 1 THEN l_orderkey END) AS example
    FROM ranked {joins} GROUP BY ALL"""


def _wins_sql(winner_aware: bool) -> str:
    second = "b.flag" if winner_aware else "a.flag"
    return f"""
    WITH {FLOW},
    flags AS (
        SELECT n_nationkey AS id,
               CASE WHEN n_regionkey <> 0 THEN n_regionkey = 1 END AS flag
        FROM nation
    )
    SELECT CASE WHEN l_returnflag = 'A' THEN a.flag ELSE {second} END AS flag, count(*) AS wins
    FROM flow JOIN flags a ON a.id = from_id JOIN flags b ON b.id = to_id
    WHERE l_returnflag IN ('A', 'R') AND a.flag <> b.flag
    GROUP BY 1"""


def _ranked_sql(n: int) -> str:
    return f"""
    WITH present AS (
        SELECT c_custkey AS id, c_name AS name, o_orderpriority AS part_id, count(*) AS words,
               row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank
        FROM customer JOIN orders ON o_custkey = c_custkey
        WHERE o_orderpriority = '5-LOW'
        GROUP BY c_custkey, c_name, c_acctbal, o_orderpriority
    )
    SELECT id, name, part_id, words, CAST(rank AS INTEGER) AS rank FROM present WHERE rank = {n}"""


def _count_sql(table: str, rule: str, source: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS violations FROM {source}"


def _repeats(table: str, keys: str) -> str:
    found = f"(SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1)"
    return _count_sql(table, f"{keys} repeats", found)


def _integrity_sql() -> str:
    return " UNION ALL ".join(
        [
            _count_sql("nation", "n_nationkey is null", "nation WHERE n_nationkey IS NULL"),
            _count_sql("nation", "n_name is null", "nation WHERE n_name IS NULL"),
            _count_sql("nation", "n_name is longer than 8", "nation WHERE length(n_name) > 8"),
            _repeats("nation", "n_nationkey"),
            _repeats("nation", "n_name"),
            _repeats("nation", "n_regionkey"),
            _count_sql("customer", "c_custkey is null", "customer WHERE c_custkey IS NULL"),
            _count_sql("customer", "balance is not negative", "customer WHERE c_acctbal < 0"),
            _repeats("customer", "c_custkey"),
            _repeats("orders", "o_orderkey"),
            _count_sql("lineitem", "l_orderkey is null", "lineitem WHERE l_orderkey IS NULL"),
            _count_sql("lineitem", "l_quantity is null", "lineitem WHERE l_quantity IS NULL"),
            _count_sql(
                "lineitem", "discount below 8 percent", "lineitem WHERE NOT l_discount < 0.08"
            ),
            _repeats("lineitem", "l_orderkey, l_linenumber"),
            _repeats("labels", "doc_id"),
            _count_sql(
                "documents", "text is longer than 586", "documents WHERE length(text) > 586"
            ),
            _count_sql(
                "customer",
                "c_nationkey has no nation",
                "customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)",
            ),
            _count_sql(
                "orders",
                "o_custkey has no customer",
                "orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
            ),
            _count_sql(
                "lineitem",
                "l_orderkey has no orders",
                "lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
            ),
            _count_sql(
                "documents",
                "doc_id has no labels",
                "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
            ),
        ]
    )


WORKLOAD = f"""
    turns AS (
        SELECT {{'conv': conv_id, 'turn': turn}} AS id, CAST(turn % 3 + 4 AS INTEGER) AS part_id,
               CAST(conv_id % 25 AS INTEGER) AS from_id,
               CAST(nullif((conv_id + turn) % 25, 24) AS INTEGER) AS to_id,
               text, CAST({WORDS} AS BIGINT) AS words
        FROM conversations
    ),
    rollup_rows AS (
        SELECT from_id AS entity_id, part_id, CAST(sum(words) AS BIGINT) AS words
        FROM turns GROUP BY 1, 2
    ),
    parts AS (
        SELECT part_id, 'part ' || part_id AS name, CAST(sum(words) + 7 AS BIGINT) AS words_total,
               count(*) * 1000003 AS money, CAST(sum(words) AS BIGINT) AS words_known
        FROM turns GROUP BY part_id
    ),
    people AS (
        SELECT n_nationkey AS id, n_name AS name, n_nationkey * 37 % 11 AS score,
               CASE WHEN n_regionkey <> 0 THEN n_regionkey = 1 END AS flag_a,
               nullif(n_regionkey, 4) AS location_id, n_nationkey % 2 = 0 AS flag_b
        FROM nation
    ),
    shares AS (
        SELECT entity_id, part_id, words,
               (CAST((2 * CAST(words AS HUGEINT) * 1000000000000 + words_total)
                     // (2 * words_total) AS HUGEINT) * money + 500000) // 1000000 AS share6
        FROM rollup_rows JOIN parts USING (part_id)
    )"""


def _workload_extreme_sql(order: str) -> str:
    return f"""
    WITH {WORKLOAD},
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY words {order}, entity_id) AS rn
        FROM shares
    )
    SELECT part_id, parts.name AS part_name, entity_id, people.name AS entity_name,
           CAST((2 * share6 + 1000000) // 2000000 AS DOUBLE) / 1000000 AS worth_in_millions
    FROM ranked JOIN parts USING (part_id) JOIN people ON people.id = entity_id WHERE rn = 1"""


def _workload_wins_sql(flag: str) -> str:
    return f"""
    WITH {WORKLOAD}
    SELECT a.{flag} AS {flag}, count(*) AS wins
    FROM supplier JOIN people a ON a.id = s_nationkey JOIN people b ON b.id = s_suppkey % 25
    WHERE (s_acctbal > 5000 OR s_acctbal < 1000) AND a.{flag} <> b.{flag}
    GROUP BY 1"""


def _workload_sql() -> dict[str, str]:
    return {
        "rollup": f"""
            WITH {WORKLOAD}
            SELECT row_number() OVER (ORDER BY entity_id, part_id) - 1 AS relation_id,
                   entity_id, part_id, words
            FROM rollup_rows""",
        "pairs": f"""
            WITH {WORKLOAD}
            SELECT from_id, to_id, CAST(sum(words) AS BIGINT) AS words
            FROM turns WHERE to_id IS NOT NULL GROUP BY 1, 2""",
        "partitions": f"WITH {WORKLOAD} SELECT * FROM parts",
        "top_with_related": f"""
            WITH {WORKLOAD},
            ranked AS (
                SELECT *, rank() OVER (PARTITION BY part_id ORDER BY words DESC) AS rk
                FROM rollup_rows
            )
            SELECT ranked.part_id, parts.name AS part_name, entity_id,
                   people.name AS entity_name, words,
                   ' ' || string_agg(master.n_name, ', ' ORDER BY master.n_name) AS related
            FROM ranked JOIN parts ON parts.part_id = ranked.part_id
            JOIN people ON people.id = entity_id
            JOIN nation ON nation.n_nationkey = entity_id
                AND nation.n_regionkey <> nation.n_nationkey
            JOIN nation master ON master.n_nationkey = nation.n_regionkey
            WHERE rk = 1 GROUP BY ALL""",
        "best_group": f"""
            WITH {WORKLOAD}
            SELECT location_id, r_name AS location_name,
                   CAST(sum(score) // count(score) AS BIGINT) AS average, count(id) AS members,
                   (SELECT name FROM people ORDER BY score DESC, id LIMIT 1) AS representative
            FROM people JOIN region ON r_regionkey = location_id
            GROUP BY location_id, r_name ORDER BY average DESC, location_id LIMIT 1""",
        "average_share": f"""
            WITH {WORKLOAD},
            grid AS (
                SELECT people.id, people.name, coalesce(share6, 0) AS share6
                FROM people CROSS JOIN parts
                LEFT JOIN shares ON shares.entity_id = people.id
                AND shares.part_id = parts.part_id
            ),
            averages AS (
                SELECT id, name, (2 * sum(share6) + count(*)) // (2 * count(*)) AS average6
                FROM grid GROUP BY id, name
            )
            SELECT id AS entity_id, name AS entity_name,
                   CAST((2 * average6 + 1000000) // 2000000 AS DOUBLE) / 1000000
                   AS worth_in_millions
            FROM averages""",
        "most_share": _workload_extreme_sql("DESC NULLS LAST"),
        "least_share": _workload_extreme_sql("ASC NULLS FIRST"),
        "pair_totals": f"""
            WITH {WORKLOAD},
            ranked AS (
                SELECT *, row_number() OVER (
                    PARTITION BY greatest(from_id, to_id), least(from_id, to_id)
                    ORDER BY words DESC, id
                ) AS rn
                FROM turns WHERE to_id IS NOT NULL
            )
            SELECT a.id AS hi_id, b.id AS lo_id, a.name AS hi_name, b.name AS lo_name,
                   CAST(sum(words) AS BIGINT) AS words,
                   max(CASE WHEN rn = 1 THEN text END) AS example
            FROM ranked JOIN people a ON a.id = greatest(from_id, to_id)
            JOIN people b ON b.id = least(from_id, to_id)
            GROUP BY a.id, b.id, a.name, b.name""",
        "flag_a_wins": _workload_wins_sql("flag_a"),
        "flag_b_wins": _workload_wins_sql("flag_b"),
        "nth_ranked": f"""
            WITH {WORKLOAD},
            numbered AS (
                SELECT row_number() OVER (ORDER BY entity_id, part_id) - 1 AS relation_id, *
                FROM rollup_rows
            ),
            ranked AS (
                SELECT people.*, numbered.*,
                       CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS INTEGER)
                       AS rank
                FROM people JOIN numbered ON id = entity_id WHERE part_id = 5
            )
            SELECT * FROM ranked WHERE rank = 3""",
    }


def sql_texts() -> dict[str, str]:
    """Query name to SQL text."""
    text_rollup_sql = f"""
        SELECT lang, source, CAST(sum({WORDS}) AS BIGINT) AS words
        FROM documents GROUP BY lang, source"""
    turn_words = f"SELECT conv_id, turn, CAST({WORDS} AS BIGINT) AS"
    pairs = "SELECT from_id, to_id, CAST(sum(qty) AS BIGINT) AS words FROM flow"
    pairs_nulls = f"""
        WITH {OPEN_FLOW}
        SELECT from_id, to_id,
               CASE WHEN to_id IS NOT NULL THEN CAST(sum(qty) AS BIGINT) END AS words
        FROM flow GROUP BY from_id, to_id"""
    return {
        "table_scan": """
            SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'""",
        "stored_rollup": text_rollup_sql,
        "appended_rollups": f"""
            SELECT lang AS word_group, CAST(sum({WORDS}) AS BIGINT) AS words
            FROM documents GROUP BY lang
            UNION ALL
            SELECT source, CAST(sum({WORDS}) AS BIGINT) FROM documents GROUP BY source""",
        "ingest_turns": f"""
            SELECT conv_id, turn, CAST(4 + turn % 2 AS INTEGER) AS part_id,
                   CASE WHEN role = 'user' THEN 0 ELSE 1 END AS from_id,
                   CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS to_id,
                   CAST({WORDS} AS BIGINT) AS word_count
            FROM conversations WHERE role IN ('user', 'assistant', 'system')""",
        "transcript_files": f"""
            SELECT CAST(4 + turn % 2 AS INTEGER) AS part_id,
                   CASE WHEN role = 'user' THEN 0 ELSE 1 END AS from_id,
                   CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS to_id,
                   count(*) AS turns, CAST(sum({WORDS}) AS BIGINT) AS words
            FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY 1, 2, 3""",

        "transcript_splits": f"""
            SELECT CAST(4 + turn % 2 AS INTEGER) AS part_id,
                   CASE WHEN role = 'user' THEN 0 ELSE 1 END AS from_id,
                   CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS to_id,
                   count(*) AS turns, CAST(sum({WORDS}) AS BIGINT) AS words
            FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY 1, 2, 3""",
        "transcript_rejects": """
            SELECT CASE WHEN role IN ('user', 'assistant') THEN 'accepted'
                        ELSE 'unlisted speaker' END AS reject,
                   CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n
            FROM (SELECT role, regexp_replace(text, '\\n+', chr(10), 'g') AS text
                  FROM conversations)
            GROUP BY 1
            UNION ALL SELECT 'direction', count(*) FROM conversations""",
        "self_replaced": f"""
            SELECT source AS word_group, CAST(sum({WORDS}) AS BIGINT) AS words
            FROM documents GROUP BY source HAVING sum({WORDS}) % 2 = 0""",
        "appended_ids": """
            SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) - 1
                   AS dialogue_id
            FROM conversations""",
        "speaker_words": f"""
            SELECT upper(role) AS speaker, CAST(turn % 2 + 1 AS INTEGER) AS source_part,
                   CAST(sum({WORDS}) AS BIGINT) AS words
            FROM conversations
            WHERE lower(role) LIKE '%sys%' OR lower(role) LIKE '%assist%' GROUP BY 1, 2""",
        "word_count": f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words FROM documents",
        "sql_word_count": f"{turn_words} words FROM conversations",
        "text_rollup": text_rollup_sql,
        "turn_update": f"{turn_words} word_count FROM conversations",
        "dim_update": """
            SELECT n_nationkey, n_name, n_regionkey, coalesce(n, -1) AS rich_suppliers
            FROM nation LEFT JOIN (
                SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1
            ) ON s_nationkey = n_nationkey""",
        "pair_stats": f"WITH {FLOW} {pairs} GROUP BY from_id, to_id",
        "pair_stats_nulls": pairs_nulls,
        "pair_strict": f"WITH {FLOW} {pairs} GROUP BY from_id, to_id",
        "pair_quarantine": f"SELECT * FROM ({pairs_nulls}) WHERE words IS NULL",
        "pair_accepted": f"SELECT * FROM ({pairs_nulls}) WHERE words IS NOT NULL",
        "top_with_related": """
            WITH rollup_rows AS (
                SELECT o_orderpriority AS part_id, n_regionkey AS entity_id, count(*) AS words
                FROM orders JOIN customer ON o_custkey = c_custkey
                JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
            ),
            tops AS (
                SELECT *, rank() OVER (PARTITION BY part_id ORDER BY words DESC) AS rk
                FROM rollup_rows
            )
            SELECT part_id, entity_id, r_name AS entity_name, words,
                   ' ' || string_agg(n_name, ', ' ORDER BY n_name) AS related
            FROM tops JOIN region ON r_regionkey = entity_id
            JOIN nation ON n_regionkey = entity_id
            WHERE rk = 1 GROUP BY part_id, entity_id, r_name, words""",
        "best_group": """
            SELECT p_brand AS location_id, CAST(sum(p_size) // count(p_size) AS BIGINT) AS average,
                   count(p_partkey) AS members,
                   (SELECT p_name FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 1)
                   AS representative
            FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
            ORDER BY average DESC NULLS LAST, location_id LIMIT 1""",
        "best_group_located": """
            WITH scored AS (
                SELECT c_custkey, c_name, c_nationkey, CAST(trunc(c_acctbal) AS BIGINT) AS score
                FROM customer
            )
            SELECT c_nationkey AS location_id, n_name AS location_name,
                   CAST(sum(score) // count(score) AS BIGINT) AS average,
                   count(c_custkey) AS members,
                   (SELECT c_name FROM scored ORDER BY score DESC NULLS LAST, c_custkey LIMIT 1)
                   AS representative
            FROM scored JOIN nation ON n_nationkey = c_nationkey
            GROUP BY c_nationkey, n_name
            ORDER BY average DESC NULLS LAST, location_id LIMIT 1""",
        "avg_share": f"""
            WITH {SHARES},
            grid AS (
                SELECT c_custkey, c_name, coalesce(share6, 0) AS share6
                FROM customer CROSS JOIN parts
                LEFT JOIN shares ON shares.entity_id = c_custkey
                AND shares.part_id = parts.part_id
            )
            SELECT c_custkey AS entity_id, c_name AS entity_name,
                   CAST((2 * sum(share6) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000
                   AS average_share
            FROM grid GROUP BY c_custkey, c_name""",
        "most_share": _extreme_sql("DESC NULLS LAST"),
        "least_share": _extreme_sql("ASC NULLS FIRST"),
        "most_words": f"""
            WITH sums AS (
                SELECT lang, source, CAST(sum({WORDS}) AS HUGEINT) AS words, sum(n_chars) AS chars
                FROM documents GROUP BY lang, source
            ),
            langs AS (
                SELECT lang, sum(words) AS total, sum(chars) AS money FROM sums GROUP BY lang
            ),
            ranked AS (
                SELECT lang, source, words,
                       row_number() OVER (PARTITION BY lang ORDER BY words DESC, source) AS rn
                FROM sums
            ),
            shares AS (
                SELECT lang, source,
                       (((2 * words * 1000000000000 + total) // (2 * total)) * money + 500000)
                       // 1000000 AS share6
                FROM ranked JOIN langs USING (lang) WHERE rn = 1
            )
            SELECT lang AS part_id, source AS entity_id,
                   CAST((2 * share6 + 1000000) // 2000000 AS DOUBLE) / 1000000
                   AS worth_in_millions
            FROM shares""",
        "pair_totals": _pair_totals_sql(FLOW, names=False),
        "pair_totals_named": _pair_totals_sql(OPEN_FLOW, names=True),
        "pair_totals_text": f"""
            WITH {FLOW},
            ranked AS (
                SELECT *, row_number() OVER (
                    PARTITION BY greatest(from_id, to_id), least(from_id, to_id)
                    ORDER BY qty DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
                ) AS rn
                FROM flow
            )
            SELECT greatest(from_id, to_id) AS hi_id, least(from_id, to_id) AS lo_id,
                   CAST(sum(qty) AS BIGINT) AS words,
                   max(CASE WHEN rn = 1 THEN l_returnflag END) AS example
            FROM ranked GROUP BY 1, 2""",
        "longest_lines": f"""
            WITH turns AS (
                SELECT CASE WHEN role = 'system' THEN NULL ELSE 1 END AS hi_id,
                       CASE WHEN role = 'system' THEN NULL ELSE 0 END AS lo_id,
                       text, {WORDS} AS words, conv_id, turn
                FROM conversations
            ),
            ranked AS (
                SELECT *, row_number() OVER (
                    PARTITION BY hi_id, lo_id ORDER BY words DESC, conv_id, turn
                ) AS rn
                FROM turns WHERE hi_id IS NOT NULL
            )
            SELECT hi_id, lo_id, CAST(sum(words) AS BIGINT) AS words,
                   max(CASE WHEN rn = 1 THEN text END) AS example
            FROM ranked GROUP BY hi_id, lo_id""",
        "flag_wins": _wins_sql(winner_aware=False),
        "flag_wins_winner_aware": _wins_sql(winner_aware=True),
        "nth_ranked": _ranked_sql(2),
        "nth_ranked_late": _ranked_sql(150),
        "nth_ranked_empty": _ranked_sql(1_000_000_000),
        "pair_totals_view": f"""
            SELECT hi_name AS name, words, example
            FROM ({_pair_totals_sql(OPEN_FLOW, names=True)}) JOIN nation ON hi_id = n_nationkey
            WHERE hi_id = lo_id AND n_regionkey <> 0""",
        "sql_extreme_shares": f"""
            SELECT 'most' AS mode, part_id, entity_id, entity_name, worth_in_millions
            FROM ({_extreme_sql("DESC")})
            UNION ALL SELECT 'least', part_id, entity_id, entity_name, worth_in_millions
            FROM ({_extreme_sql("ASC")})""",
        "sql_nth_ranked": """
            SELECT c_custkey AS id, c_name AS name, c_acctbal AS score, words, place FROM (
                SELECT customer.*, words, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place
                FROM customer JOIN (
                    SELECT o_custkey, count(*) AS words FROM orders
                    WHERE o_orderpriority = '5-LOW' GROUP BY 1
                ) ON o_custkey = c_custkey
            ) WHERE place IN (2, 10)""",
        **{f"workload_{name}": sql for name, sql in _workload_sql().items()},
        "dup_keys": """
            SELECT l_orderkey, l_linenumber, count(*) AS copies
            FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "orphans": """
            SELECT o_orderkey, o_custkey FROM orders
            WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
        "null_length_check": """
            SELECT doc_id FROM documents
            WHERE text IS NULL OR lang IS NULL OR length(text) > 586""",
        "null_length_counts": """
            SELECT 'text is null' AS rule, count(*) FILTER (text IS NULL) AS violations
            FROM documents
            UNION ALL SELECT 'lang is null', count(*) FILTER (lang IS NULL) FROM documents
            UNION ALL SELECT 'text is longer than 586', count(*) FILTER (length(text) > 586)
            FROM documents
            UNION ALL SELECT 'source is longer than 20', count(*) FILTER (length(source) > 20)
            FROM documents""",
        "most_share_truncated": f"""
            WITH {SHARES.replace(ROUNDED, TRUNCATED)},
            ranked AS (
                SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY n DESC, entity_id) AS rn
                FROM shares
            )
            SELECT part_id, part_id AS part_name, entity_id, c_name AS entity_name,
                   CAST(share6 // 1000000 AS DOUBLE) / 1000000 AS worth_in_millions
            FROM ranked JOIN customer ON c_custkey = entity_id WHERE rn = 1""",
        "avg_share_truncated": f"""
            WITH {SHARES.replace(ROUNDED, TRUNCATED)},
            grid AS (
                SELECT c_custkey, c_name, coalesce(share6, 0) AS share6
                FROM customer CROSS JOIN parts
                LEFT JOIN shares ON entity_id = c_custkey AND shares.part_id = parts.part_id
            )
            SELECT c_custkey AS entity_id, c_name AS entity_name,
                   CAST((2 * sum(share6) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000 AS average_share
            FROM grid GROUP BY 1, 2""",
        "refreshed_views": """
            SELECT CASE WHEN n_nationkey < 2 THEN 4 ELSE n_regionkey END AS n_regionkey,
                   count(*) AS customers, 'per_region' AS made_again
            FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
        "name_fragments": """
            SELECT DISTINCT right(s_name, 4) AS fragment, c_name AS name
            FROM supplier JOIN customer ON contains(c_name, right(s_name, 4))""",
        "dup_words_collated": f"""
            SELECT min(word) AS word, count(*) AS copies FROM ({FIRST_WORDS.format("documents")})
            WHERE word <> '' GROUP BY lower(word) HAVING count(*) > 1""",
        "orphans_collated": f"""
            SELECT word FROM ({FIRST_WORDS.format("documents")}) WHERE word <> '' AND lower(word) NOT IN (
                SELECT lower(word) FROM ({FIRST_WORDS.format("conversations")}) WHERE word IS NOT NULL)""",
        "nth_line": _nth_line_sql(1),
        "nth_line_late": _nth_line_sql(5000),
        "folded_rollup": """
            SELECT l_suppkey, l_returnflag,
                   CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS words, count(*) AS turns
            FROM lineitem GROUP BY 1, 2""",
        "folded_speakers": f"""
            WITH spoken AS (SELECT *, CAST({WORDS} AS BIGINT) AS n FROM conversations)
            SELECT role, CAST(sum(n) AS BIGINT) AS words, count(*) AS turns,
                   arg_min(conv_id, (-n, conv_id, turn)) AS conv_id,
                   arg_min(turn, (-n, conv_id, turn)) AS turn
            FROM spoken GROUP BY role""",
        "updated_partitions": """
            SELECT c_custkey, c_name, c_nationkey,
                   CASE WHEN c_mktsegment = 'BUILDING' AND n IS NOT NULL THEN CAST(n AS DOUBLE)
                        ELSE c_acctbal END AS c_acctbal,
                   c_mktsegment
            FROM customer
            LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
        "deleted_in_files": """
            SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
            WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
        "orphan_keys": """
            SELECT DISTINCT l_orderkey FROM lineitem
            WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 20000)""",
        "orphans_by_bitmap": """
            SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
            WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 20000)""",
        "predicate_check": f"""
            WITH {FLOW}
            SELECT l_orderkey, l_linenumber, from_id, to_id, qty
            FROM flow WHERE from_id = to_id""",
        "coverage": """
            SELECT count(*) AS matches, count(*) <> 0 AS holds
            FROM documents JOIN labels ON labels.doc_id = documents.doc_id""",
        "uncovered": """
            SELECT doc_id, lang FROM documents
            WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""",
        "integrity_report": _integrity_sql(),
        "dense_ids": """
            SELECT c_mktsegment, c_custkey,
                   row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS dense_id
            FROM customer""",
        "cascade": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 0",
        "cascade_second_level": """
            SELECT s_suppkey, s_nationkey FROM supplier
            WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""",
        "refused": """
            SELECT c_custkey, c_nationkey FROM customer
            JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0""",
        "set_null": """
            SELECT c_custkey, CASE WHEN n_regionkey <> 0 THEN c_nationkey END AS c_nationkey
            FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
        "defaults": """
            SELECT n_nationkey, n_name, n_regionkey, CAST(1 AS INTEGER) AS n_moons,
                   CAST(NULL AS VARCHAR) AS n_comment
            FROM nation""",
    }
