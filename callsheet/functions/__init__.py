"""Column expressions shared by the operators; no Python runs per row."""

from callsheet.functions.numbers import integer_average, money_share, share_in_millions, truncated_quotient
from callsheet.functions.sql import register_functions, register_reports
from callsheet.functions.text import joined_names, word_count

__all__ = [
    "integer_average",
    "joined_names",
    "money_share",
    "register_functions",
    "register_reports",
    "share_in_millions",
    "truncated_quotient",
    "word_count",
]
