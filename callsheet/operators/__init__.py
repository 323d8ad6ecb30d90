"""Derivations, quality jobs, keys and deletes over DataFrames."""

from callsheet.operators.bitmaps import orphan_keys, orphans_by_bitmap
from callsheet.operators.deletes import DeleteRefused, delete_rows, refusals
from callsheet.operators.derive import (
    RejectedPairs,
    accept_pairs,
    entity_rollup,
    pair_rollup,
    split_pairs,
    update_from,
    with_word_count,
)
from callsheet.operators.keys import dense_ids, fill_defaults
from callsheet.operators.quality import (
    breaking_rows,
    column_violations,
    coverage,
    duplicate_keys,
    integrity_report,
    orphans,
    rows_with_violations,
    uncovered,
)
from callsheet.operators.ranking import nth_row

__all__ = [
    "DeleteRefused",
    "RejectedPairs",
    "accept_pairs",
    "breaking_rows",
    "column_violations",
    "coverage",
    "delete_rows",
    "dense_ids",
    "duplicate_keys",
    "entity_rollup",
    "fill_defaults",
    "integrity_report",
    "nth_row",
    "orphan_keys",
    "orphans",
    "orphans_by_bitmap",
    "pair_rollup",
    "refusals",
    "rows_with_violations",
    "split_pairs",
    "uncovered",
    "update_from",
    "with_word_count",
]
