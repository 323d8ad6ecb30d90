"""The numbered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from callsheet.llm import bpe, languages, manifest, near, oracles, packing, quality, secrets, shards, spelling, substrings, suffixes, token_files, topk
from callsheet.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_files.digests(table(spark, sf_dir, "documents"), vocabulary, end_id=1)


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.law_rows(table(spark, sf_dir, "documents"), shards=8)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return languages.predictions(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near.digests(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_threshold_top_k": op1_threshold_top_k,
        "op2_token_files": op2_token_files,
        "op3_byte_shards": op3_byte_shards,
        "op4_quality_rules": op4_quality_rules,
        "op5_secret_scans": op5_secret_scans,
        "op6_language_mixture": op6_language_mixture,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_suffix_array_dedup": op13_suffix_array_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL texts of those whose results SQL can express in full."""
    return oracles.oracle_sql()
