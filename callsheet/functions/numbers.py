"""Exact arithmetic: truncated integer averages and fixed-point money shares."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer_average(value: Column) -> Column:
    """Aggregate: average of integers, cut toward zero; NULLs are skipped."""
    filled = F.nullif(F.count(value), F.lit(0).cast("long"))
    return F.call_function("div", F.sum(value), filled)


def truncated_quotient(value: Column, by: Column) -> Column:
    """The whole part of a quotient of whole decimals of up to 32 digits, toward zero:
    the remainder is taken off first, so that the division is exact."""
    return ((value - value % by) / by).cast("decimal(38,0)")


def _truncated_share(words: Column, total: Column, money: Column) -> Column:
    """The share in whole millionths, cut at every step instead of rounded.

    The ratio has 12 decimals, so ratio times money may have more than the 38 digits
    of a decimal; it is therefore divided in two parts, above and below a millionth.
    """
    million = F.lit(1_000_000).cast("decimal(7,0)")
    words, total, money = words.cast("decimal(26,0)"), total.cast("decimal(20,0)"), money.cast("decimal(20,0)")
    rest = (words % total).cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
    ratio = truncated_quotient(words, total) * million * million + truncated_quotient(rest, total)
    ratio = ratio.cast("decimal(38,0)")
    above = truncated_quotient(ratio, million).cast("decimal(32,0)")
    below = (ratio % million).cast("decimal(7,0)") * money
    return (above * money + truncated_quotient(below, million)).cast("decimal(38,0)")


def _millionths(units: Column) -> Column:
    return (units.cast("decimal(32,0)") * F.lit(Decimal("0.000001"))).cast("decimal(38,6)")


def money_share(words: Column, total: Column, money: Column, truncate: bool = False) -> Column:
    """``words / total * money`` as decimal(38,6), for any bigint operands.

    With ``truncate`` the ratio is cut at 12 decimals and the share at 6, as the
    original database does, in exact integers.

    Otherwise the operand precisions make the division round once, at 12
    decimals, and leave the product 6. A zero total raises DIVIDE_BY_ZERO (ANSI
    mode, the default); a NULL operand gives NULL.
    """
    if truncate:
        return _millionths(_truncated_share(words, total, money))
    ratio = words.cast("decimal(26,0)") / total.cast("decimal(20,0)")
    return ratio.cast("decimal(24,12)") * money.cast("decimal(20,0)")


def share_in_millions(words: Column, total: Column, money: Column, truncate: bool = False) -> Column:
    """:func:`money_share` in millions, again with six decimals."""
    if truncate:
        units = _truncated_share(words, total, money)
        return _millionths(truncated_quotient(units, F.lit(1_000_000).cast("decimal(7,0)")))
    return (money_share(words, total, money) / F.lit(1_000_000)).cast("decimal(38,6)")
