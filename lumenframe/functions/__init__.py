"""Scalar functions whose usual SQL form differs from Spark's, as Column expressions.

All of them are built from JVM-side functions, so they stay within whole-stage
code generation.
"""

from lumenframe.functions.casts import days_to_date, to_number, to_text, ts_from_ns
from lumenframe.functions.dates import day_of_week, java_format, parse_date, parse_timestamp, ts_diff
from lumenframe.functions.maths import ceil_double, floor_double, int_div, ln_ieee, log10_ieee, modulo, null_safe_div
from lumenframe.functions.text import left_chars, like_prefix, regex_replace, right_chars, strip_chars, substring_from, title

__all__ = [
    "ceil_double", "day_of_week", "days_to_date", "floor_double", "int_div", "java_format", "left_chars", "like_prefix", "ln_ieee", "log10_ieee",
    "modulo", "null_safe_div", "parse_date", "parse_timestamp", "regex_replace", "right_chars", "strip_chars", "substring_from", "title",
    "to_number", "to_text", "ts_diff", "ts_from_ns",
]
