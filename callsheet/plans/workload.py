"""From the base tables over the derived ones to the nine reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions import register_functions, register_reports
from callsheet.operators import (
    accept_pairs,
    dense_ids,
    entity_rollup,
    pair_rollup,
    update_from,
    with_word_count,
)
from callsheet.plans.reports import (
    MILLION,
    average_share,
    best_group,
    extreme_share,
    flag_wins,
    nth_ranked,
    pair_totals,
    top_with_related,
)
from callsheet.session import materialise

Report = Callable[[Mapping[str, DataFrame]], DataFrame]


class DerivedTables(Mapping[str, DataFrame]):
    """The base tables and the derived ones, each made when it is first asked for.

    A report that needs neither texts nor ids thus reads no text and writes
    nothing. ``rollup_words`` is the rollup without ids, folded from the texts in
    one scan; part totals are summed from it, and only ``rollup`` itself is
    numbered, for whom the ids matter. Pairs come from ``turn_words``, a narrow
    table of the measured texts. The texts themselves are not written again:
    ``turn`` is the given table with its count.
    """

    def __init__(self, tables: Mapping[str, DataFrame], pair_mode: str):
        self._base, self._mode = dict(tables), pair_mode
        self._made: dict[str, DataFrame] = {}
        self._makers = {
            "turn": lambda: with_word_count(self._base["turn"]),
            "turn_words": self._turn_words,
            "rollup_words": self._rollup_words,
            "rollup": self._rollup,
            "pair": lambda: accept_pairs(pair_rollup(self["turn_words"]), mode=self._mode),
            "partition": self._partition,
        }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._makers:
            return self._base[name]
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter({**self._base, **self._makers})

    def __len__(self) -> int:
        return len({**self._base, **self._makers})

    def _turn_words(self) -> DataFrame:
        narrow = self["turn"].select("id", "part_id", "from_id", "to_id", "word_count")
        return materialise(narrow, "words")

    def _rollup_words(self) -> DataFrame:
        spoken = entity_rollup(self["turn"]).withColumnRenamed("from_id", "entity_id")
        return materialise(spoken, "rollup-words")

    def _rollup(self) -> DataFrame:
        numbered = dense_ids(self["rollup_words"], ["entity_id", "part_id"], into="relation_id")
        return numbered.select("relation_id", "entity_id", "part_id", "words")

    def _partition(self) -> DataFrame:
        per_part = self["rollup_words"].groupBy("part_id").agg(F.sum("words").alias("words"))
        parts = update_from(
            self._base["partition"], "part_id", per_part, "part_id", "words_known", "words"
        )
        return materialise(parts, "parts")  # few rows, whose size the reports' joins then know


def derive(tables: Mapping[str, DataFrame], pair_mode: str = "strict") -> DerivedTables:
    """Turn words, rollup, pairs and part totals of ``partition, location, entity,
    turn, relation, contest``, each on demand."""
    return DerivedTables(tables, pair_mode)


def _rollup_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rollup that a report reads: without ids where the tables have it."""
    return tables["rollup_words"] if "rollup_words" in tables else tables["rollup"]


def _average_share_in_millions(tables: Mapping[str, DataFrame]) -> DataFrame:
    shares = average_share(tables["entity"], _rollup_of(tables), tables["partition"])
    in_millions = (F.col("average_share") / F.lit(MILLION)).cast("decimal(38,6)")
    return shares.select(
        "entity_id", "entity_name", in_millions.alias("worth_in_millions")
    ).orderBy(F.col("worth_in_millions").desc(), "entity_id")


def _extreme_share(mode: str) -> Report:
    return lambda t: extreme_share(_rollup_of(t), t["partition"], t["entity"], mode)


def _flag_wins(flag: str) -> Report:
    return lambda t: flag_wins(t["contest"], t["entity"], flag)


REPORTS: dict[str, Report] = {
    "top_with_related": lambda t: top_with_related(
        _rollup_of(t), t["relation"], t["entity"], t["partition"]
    ),
    "best_group": lambda t: best_group(t["entity"], t["location"]),
    "average_share": _average_share_in_millions,
    "most_share": _extreme_share("most"),
    "least_share": _extreme_share("least"),
    "pair_totals": lambda t: pair_totals(
        t["turn_words"], t["entity"], texts=t["turn"]
    ).orderBy(F.col("words").desc(), "hi_id", "lo_id"),
    "flag_a_wins": _flag_wins("flag_a"),
    "flag_b_wins": _flag_wins("flag_b"),
}


def all_reports(
    tables: Mapping[str, DataFrame], nth_part: int | None = None, nth: int = 2
) -> dict[str, DataFrame]:
    """The reports over derived tables; the ninth only if a part is named."""
    found = {name: report(tables) for name, report in REPORTS.items()}
    if nth_part is not None:
        found["nth_ranked"] = nth_ranked(tables["entity"], tables["rollup"], nth_part, nth)
    return found


def create_views(tables: Mapping[str, DataFrame], found: Mapping[str, DataFrame]) -> None:
    """Offer tables and reports to SQL users as temporary views, with the functions:
    ``word_count``, and the reports with parameters where their tables are there.

    The views are snapshots: some reports have written their few result rows.
    :func:`live_views` makes them anew from the tables as they are.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for name, df in found.items():
        df.createOrReplaceTempView(f"report_{name}")
    spark = next(iter(tables.values())).sparkSession
    register_functions(spark)
    if {"entity", "partition", "rollup"} <= set(tables):
        register_reports(spark)


def live_views(
    read_tables: Callable[[], Mapping[str, DataFrame]], pair_mode: str = "strict"
) -> Callable[[], None]:
    """Create the views over the tables that ``read_tables`` returns, and return a
    function that does so again: after a base table has changed, it brings all
    derived tables and reports to the same, current state."""

    def refresh() -> None:
        tables = derive(read_tables(), pair_mode)
        create_views(tables, all_reports(tables))

    refresh()
    return refresh
