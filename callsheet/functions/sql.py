"""Functions for users who write SQL: per row, and reports with parameters."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession) -> None:
    """Create ``word_count(line)`` for this session; it folds into the plan."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION word_count(line STRING)
        RETURNS BIGINT
        RETURN octet_length(rtrim(line)) - octet_length(replace(line, ' ', '')) + 1
        """
    )


#: Places between ranges of scores, in the SQL form of the n-th row.
RANGES = 64


def register_reports(spark: SparkSession) -> None:
    """Create the reports with parameters as table functions of this session:

    * ``extreme_share(mode)``: per part the entity with the ``'most'`` or ``'least'``
      of its money, in millions; another mode is an error;
    * ``nth_ranked(part, n)``: the entity with the n-th largest score in a part; a
      rank that does not exist, or NULL, gives no row.

    They read the views ``entity``, ``partition`` and ``rollup`` as they are when a
    query calls them, and fold into its plan, so filters and columns of the query
    reach the scans. Ties go to the smallest id.

    For ``extreme_share`` each task keeps its best row per part. For ``nth_ranked``,
    whose n is known to the plan only, 64 approximate quantiles cut the scores into
    ranges; the ranges are counted, and only the one that holds the rank is sorted.
    """
    entity, rollup = (spark.table(f"`{name}`").schema for name in ("entity", "rollup"))
    kind = {name: field.simpleString() for name, field in (
        ("id", entity["id"].dataType), ("name", entity["name"].dataType),
        ("score", entity["score"].dataType) if "score" in entity.names else ("score", rollup["words"].dataType),
        ("part", rollup["part_id"].dataType), ("words", rollup["words"].dataType),
    )}
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION extreme_share(mode STRING)
        RETURNS TABLE (part_id {kind["part"]}, part_name STRING, entity_id {kind["id"]},
                       entity_name STRING, worth_in_millions DECIMAL(38,6))
        RETURN
        WITH ranked AS (
            SELECT part_id, entity_id, words, row_number() OVER (
                PARTITION BY part_id
                ORDER BY CASE lower(extreme_share.mode)
                             WHEN 'most' THEN words
                             WHEN 'least' THEN NULL
                             ELSE raise_error('mode must be most or least') END DESC NULLS LAST,
                         CASE WHEN lower(extreme_share.mode) = 'least' THEN words END ASC NULLS FIRST,
                         entity_id) AS place
            FROM rollup
        )
        SELECT r.part_id, CAST(p.name AS STRING), r.entity_id, CAST(e.name AS STRING),
               CAST(CAST(CAST(r.words AS DECIMAL(26,0)) / CAST(p.words_total AS DECIMAL(20,0))
                         AS DECIMAL(24,12)) * CAST(p.money AS DECIMAL(20,0)) / 1000000 AS DECIMAL(38,6))
        FROM ranked r
        JOIN `partition` p ON p.part_id = r.part_id
        JOIN entity e ON e.id = r.entity_id
        WHERE r.place = 1
        """
    )
    if "score" not in entity.names:
        return
    quantiles = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION nth_ranked(part {kind["part"]}, n BIGINT)
        RETURNS TABLE (id {kind["id"]}, name STRING, score {kind["score"]}, words {kind["words"]}, place BIGINT)
        RETURN
        WITH present AS (
            SELECT e.id, e.name, e.score, r.words
            FROM rollup r JOIN entity e ON e.id = r.entity_id
            WHERE r.part_id = nth_ranked.part
        ),
        cuts AS (
            SELECT percentile_approx(score, array({quantiles})) AS cuts
            FROM present
        ),
        ranged AS (
            -- scores above more cuts come first; a NULL score comes last
            SELECT id, name, score, words, coalesce(size(filter(cuts, c -> c > score)), {RANGES}) AS at
            FROM (SELECT present.*, (SELECT cuts FROM cuts) AS cuts FROM present)
        ),
        counts AS (
            SELECT at, rows, sum(rows) OVER (ORDER BY at) AS upto
            FROM (SELECT CASE WHEN score IS NULL THEN {RANGES + 1} ELSE at END AS at, count(*) AS rows
                  FROM ranged GROUP BY 1)
        ),
        hit AS (
            SELECT at, nth_ranked.n - (upto - rows) AS rest FROM counts
            WHERE upto >= nth_ranked.n AND upto - rows < nth_ranked.n AND nth_ranked.n > 0
        ),
        placed AS (
            SELECT ranged.*, hit.rest,
                   row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS place
            FROM ranged JOIN hit ON hit.at = CASE WHEN score IS NULL THEN {RANGES + 1} ELSE ranged.at END
        )
        SELECT id, CAST(name AS STRING), score, words, nth_ranked.n FROM placed WHERE place = rest
        """
    )
