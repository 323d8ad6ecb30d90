"""A training corpus from raw documents: five stages, each written and read again.

``STAGES`` lists them; ``run`` applies them to the ``documents`` table. All but
the last return the columns of ``documents``; a stage's decisions take effect in
what it returns. Intermediate tables are Parquet in the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a stage at most a
re-read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.llm import near, packing, quality, secrets, substrings
from callsheet.llm.common import ship, table
from callsheet.session import materialise


def _retexted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows a changed text; other columns stay."""
    if "n_chars" not in columns:
        return docs.select(*columns)
    return docs.select(
        *[
            F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in columns
        ]
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled threshold rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-equal texts stays."""
    ship(spark)
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 35-word windows that come anywhere else, too, are cut out.

    A document that loses words keeps the others, joined by blanks (perhaps
    none); any other keeps its text as it is.
    """
    ship(spark)
    found = substrings.without_repeats(docs, layout=True)
    changed = F.col("n_removed") > 0
    texts = F.when(F.col("row.no_text"), F.lit(None)).otherwise(F.col("kept"))
    whole = found.select(
        *[
            texts.alias(c) if c == "text" else F.col("row")[c].alias(c)
            for c in docs.columns
        ],
        changed.alias("_changed"),
    )
    return _retexted(whole, docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    before = F.col("text")
    marked = secrets.redact(docs.withColumn("_before", before))
    whole = marked.withColumn("_changed", ~F.col("text").eqNullSafe(F.col("_before")))
    return _retexted(whole, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4,096 tokens."""
    ship(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Samples, suffix trees and packing have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
