"""Contiguous shards of nearly equal size in bytes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import ordered_prefixes


def byte_shards(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Deal documents to ``shards`` contiguous ranges of ``key`` by bytes.

    A document's size is its UTF-8 length plus 1. The sizes of all documents
    before it, in the order of the key, come from the totals of sorted ranges;
    the shard is the equal target that the document's middle byte falls into.
    So a shard's size is off its target by less than two halves of a document
    at its ends. Contiguity is the point: a shard is a range of keys.

    Returns key, ``size``, ``text_crc32``, ``shard``, ``slot`` (place in the
    shard, gapless from 0). A null text counts as empty, null keys come first,
    rows with one key follow their checksum and size, repeated rows are kept as
    they are, no rows give no rows. Other columns of ``docs`` are not read.
    """
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    placed = ordered_prefixes(sized, ["doc_id", "text_crc32", "size"], "size", "byte-shards")
    target = F.expr(f"least({shards - 1}, (before * 2 + size) * {shards} div (total * 2))")
    dealt = placed.withColumn("shard", target.cast("int"))
    first = dealt.groupBy("shard").agg(F.min("row").alias("_first"))
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("doc_id").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("row") - F.col("_first")).alias("slot"),
    )


def law_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest rows of the sharding query."""
    return byte_shards(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
