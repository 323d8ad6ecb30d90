"""Quality rules with risk-controlled thresholds (DataFrame and SQL functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.common import SPACE
from callsheet.session import materialise

#: Base rule: fewer words, or a larger percentage in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

#: Signals and their cutoffs, from the most lenient to the strictest. A document
#: is rejected where a signal is above its stratum's cutoff.
SIGNALS = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05],
    "duplicate_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeated_words": [0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03],
    "long_words": [14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5],
    "short_words": [-2.0, -2.5, -3.0, -3.25, -3.5],
}
#: Share of good documents that a stratum may lose to all signals together, and
#: the chance that any stratum's share is larger after all.
RISK, ERROR = 0.05, 0.05


# --- what is measured in each text --------------------------------------------


def _pairs(hashes: Column, step: int, n: Column) -> Column:
    """Hashes of twice the width, from those that are ``step`` words apart."""
    return F.zip_with(
        F.slice(hashes, F.lit(1), n - step),
        F.slice(hashes, F.lit(step + 1), n - step),
        lambda a, b: F.xxhash64(a, b),
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_m``, a struct of the measures of each whole text.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (of
    ``#*$%&|<>``); ``n_lines`` and ``n_dup_lines`` (lines with a word, and those
    equal to an earlier one); ``n_repeat_words``: words covered by 8-word windows
    that occur twice or more in the text. Windows are compared by 64-bit hashes
    within one text, built by doubling, and only texts where two are equal are
    sorted to find which. A null text has no words. Row by row: no shuffle.
    """
    clear = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split("_text", SPACE, -1), lambda w: w != "")
    split = clear.withColumn("_words", words)
    hashed = split.select(
        *docs.columns,
        F.size("_words").alias("_n"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    n = F.col("_n")
    wide = (
        hashed.withColumn("_h2", F.when(n >= WINDOW, _pairs(F.col("_h1"), 1, n)))
        .withColumn("_h4", F.when(n >= WINDOW, _pairs(F.col("_h2"), 2, n - 1)))
        .withColumn("_h8", F.when(n >= WINDOW, _pairs(F.col("_h4"), 4, n - 3)))
        .drop("_h1", "_h2", "_h4")
    )
    any_twice = F.size(F.array_distinct("_h8")) < F.size("_h8")
    placed = F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = wide.withColumn("_placed", F.when(any_twice, placed))
    p = F.col("_placed")
    repeated = F.filter(
        p,
        lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    found = sorted_.withColumn("_starts", starts)
    s = F.col("_starts")
    covered = F.aggregate(
        F.transform(
            s, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - i, F.lit(WINDOW)))
        ),
        F.lit(0).cast("long"),
        lambda total, more: total + more,
    )
    lines = F.size("_lines").cast("long")
    return found.select(
        *docs.columns,
        F.struct(
            n.cast("long").alias("n_words"),
            F.col("_chars").alias("word_chars"),
            F.col("_symbols").alias("n_symbols"),
            lines.alias("n_lines"),
            (lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        ).alias("_m"),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (
        m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED
    )


def signals(m: Column) -> dict[str, Column]:
    """The signals, higher being worse; a text without words has none above 0."""
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return {
        "symbols_per_word": per(m["n_symbols"], m["n_words"]),
        "duplicate_lines": per(m["n_dup_lines"], m["n_lines"]),
        "repeated_words": per(m["n_repeat_words"], m["n_words"]),
        "long_words": per(m["word_chars"], m["n_words"]),
        "short_words": -F.coalesce(
            F.try_divide(m["word_chars"].cast("double"), m["n_words"]), F.lit(float("inf"))
        ),
    }


# --- exact binomial bounds, as column expressions --------------------------------


def _log_factorial(n: Column) -> Column:
    """ln(n!), by Stirling's series, which is exact to 1e-12 from 16 on; below by product."""
    x = n.cast("double") + 1
    series = (
        (x - 0.5) * F.log(x)
        - x
        + 0.5 * math.log(2 * math.pi)
        + 1 / (x * 12)
        - 1 / (x * x * x * 360)
        + 1 / (x * x * x * x * x * 1260)
    )
    small = F.aggregate(
        F.sequence(F.lit(0), F.least(n, F.lit(15)).cast("int")),
        F.lit(0.0),
        lambda total, i: total + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0),
    )
    return F.when(n < 16, small).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of Binomial(n, p), exactly up to rounding.

    Terms are summed downwards from k, in logarithms relative to the term at k;
    below the mean they shrink at least geometrically, and those after the
    first 40 + 12 sqrt(n) are below any rounding. Above the mean the answer is
    only compared with small levels, and the terms at least reach the mean.
    """
    first = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(p) + (n - k) * F.log(1 - p)
    )
    steps = F.least(k, (F.sqrt(n.cast("double")) * 12 + 40).cast("long")).cast("int")

    def add(state: Column, j: Column) -> Column:
        i = k - j + 1  # from the term at i to the one below
        term = state["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    below = F.when(steps < 1, F.lit(1.0)).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add, lambda s: s["sum"]
        )
    )
    return F.least(F.exp(first) * below, F.lit(1.0))


# --- thresholds -------------------------------------------------------------------


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    stratum: str = "lang",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """``stratum`` and, per signal, the strictest cutoff that is proven safe there.

    The labelled good documents (quality 1) that pass the base rule are the
    holdout; nothing was fitted to them, as the cutoffs to try are fixed. For a
    signal and cutoff, k of the stratum's n are rejected wrongly. The cutoff is
    safe when P(X <= k) of Binomial(n, risk / signals) is at most its level, so
    the exact upper (Clopper-Pearson) bound of its false rejections is below
    risk / signals, and the signals together stay below ``risk``. The level is
    ``error`` divided by strata and signals (Bonferroni); along a signal's
    cutoffs they are tested in the fixed order from lenient to strict up to the
    first that fails, which needs no further correction. A signal with no safe
    cutoff rejects nothing, so a stratum without labels keeps all.

    Counted over all labelled rows, summed by cutoff before any shuffle. A
    document with several labels is good only if all are; null keys and null
    qualities are no labels; a null stratum is one of its own.
    """
    good = (
        labels.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg((F.min("quality") == 1).alias("_good"))
        .where("_good")
        .select("_key")
    )
    passing = measured.where(~base_failed(F.col("_m")))
    held = passing.join(good, F.col(key) == F.col("_key"), "left_semi")
    tried = [
        F.sum((value > cut).cast("long")).alias(f"{name}_{i}")
        for name, value in signals(F.col("_m")).items()
        for i, cut in enumerate(SIGNALS[name])
    ]
    counted = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *tried)
    level = F.lit(error) / (F.count("*").over(Window.partitionBy()) * len(SIGNALS))
    levelled = counted.withColumn("_level", level)
    share = F.lit(risk / len(SIGNALS))

    chosen = []
    for name, cuts in SIGNALS.items():
        options = F.array(
            *[
                F.struct(F.col(f"{name}_{i}").alias("k"), F.lit(cut).alias("cut"))
                for i, cut in enumerate(cuts)
            ]
        )
        tested = F.transform(
            options,
            lambda o: F.struct(
                o["cut"].alias("cut"),
                (binomial_tail(o["k"], F.col("n"), share) <= F.col("_level")).alias("safe"),
            ),
        )
        walked = F.aggregate(
            tested,
            F.struct(F.lit(True).alias("on"), F.lit(float("inf")).alias("cut")),
            lambda s, t: F.struct(
                (s["on"] & t["safe"]).alias("on"),
                F.when(s["on"] & t["safe"], t["cut"]).otherwise(s["cut"]).alias("cut"),
            ),
            lambda s: s["cut"],
        )
        chosen.append(walked.alias(name))
    return levelled.select("stratum", *chosen)


def judged(measured: DataFrame, safe: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``_kept``; ``safe`` is the written table of cutoffs, a row per stratum."""
    cuts = safe.select("stratum", F.struct(*SIGNALS).alias("_cuts"))
    joined = measured.join(cuts, measured[stratum].eqNullSafe(cuts["stratum"]), "left")
    m = F.col("_m")
    bad = F.lit(False)
    for name, value in signals(m).items():
        bad = bad | F.coalesce(value > F.col("_cuts")[name], F.lit(False))
    return joined.withColumn("_kept", ~base_failed(m) & ~bad).drop("stratum", "_cuts")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest rows: measures, base rule and verdict of every document.

    Texts are measured once into a narrow table; labels and cutoffs only meet
    that. Rows with null keys or texts are judged too; repeated rows stay.
    """
    narrow = docs.select("doc_id", "lang", "text")
    measured = materialise(with_measures(narrow).drop("text"), "quality-measures")
    safe = materialise(cutoffs(measured, labels), "quality-cutoffs")
    m = F.col("_m")
    return judged(measured, safe).select(
        "doc_id",
        *[
            m[name].alias(name)
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ],
        base_failed(m).alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns as they are.

    The rows are written once with their measures, so texts are measured once
    and never shuffled; the few cutoffs come to them.
    """
    columns = docs.columns
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", "lang", "text"
    )
    kept_text = with_measures(whole).drop("text")
    measured = materialise(kept_text, "quality-rows")
    safe = materialise(cutoffs(measured, labels), "quality-cutoffs")
    return judged(measured, safe).where("_kept").select(*[F.col("_row")[c].alias(c) for c in columns])
