"""The reports, and the whole workload from base tables to reports."""

from callsheet.plans.reports import (
    average_share,
    best_group,
    extreme_share,
    flag_wins,
    nth_ranked,
    pair_totals,
    top_with_related,
)
from callsheet.plans.snapshots import Snapshots, fingerprint
from callsheet.plans.workload import REPORTS, all_reports, create_views, derive, live_views

__all__ = [
    "REPORTS",
    "Snapshots",
    "all_reports",
    "average_share",
    "best_group",
    "create_views",
    "derive",
    "extreme_share",
    "fingerprint",
    "flag_wins",
    "live_views",
    "nth_ranked",
    "pair_totals",
    "top_with_related",
]
