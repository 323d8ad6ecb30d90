"""Text measures and text aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Blank-separated words: inner blanks plus one; NULL stays NULL.

    Only trailing blanks are ignored, so ``''`` and ``'   '`` give 1, ``' a'``
    gives 2 and ``'a  b'`` gives 3. Both lengths are taken in bytes: they differ
    by blanks alone, which are one byte each, and a byte length needs no walk
    over the text. The whole text counts, whatever length a column declares;
    over-long texts are found by the length rules.
    """
    squeezed = F.replace(text, F.lit(" "), F.lit(""))
    return (F.octet_length(F.rtrim(text)) - F.octet_length(squeezed) + 1).cast("long")


def joined_names(name: Column, separator: str = ", ", leading_blank: bool = True) -> Column:
    """Aggregate: every non-NULL name of the group, sorted, repeats kept.

    A group without any name gives NULL. The reports start the list with a
    blank; ``leading_blank=False`` gives the clean form.
    """
    names = F.array_join(F.array_sort(F.collect_list(name)), separator)
    if leading_blank:
        names = F.concat(F.lit(" "), names)
    return F.when(F.count(name) > 0, names)
