"""Strings: positions that count from 1, sets of characters, back-references."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def substring_from(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Characters from ``start`` on; a start below 1 counts as 1, a length below 0 as 0."""
    start = F.greatest(_col(start), F.lit(1))
    length = F.char_length(s) if length is None else F.greatest(_col(length), F.lit(0))
    return F.substring(s, start, length)


def left_chars(s: Column, n: Column | int) -> Column:
    return F.left(s, F.greatest(_col(n), F.lit(0)))


def right_chars(s: Column, n: Column | int) -> Column:
    return F.right(s, F.greatest(_col(n), F.lit(0)))


def strip_chars(s: Column, chars: str = " ", side: str = "both") -> Column:
    """Removes any of ``chars`` from the ends."""
    trim = {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side.lower()]
    return trim(s, F.lit(chars))


def java_replacement(text: str) -> str:
    r"""A replacement with ``\1`` back-references in the form that Java reads."""
    out = re.sub(r"\$", r"\\$", text)
    return re.sub(r"\\(\d)", r"$\1", out)


def regex_replace(s: Column, pattern: str, replacement: str, position: int = 1) -> Column:
    """Replaces every match at or after ``position``; what stands before it is kept as it is."""
    new = java_replacement(replacement)
    if position <= 1:
        return F.regexp_replace(s, pattern, new)
    head, tail = F.left(s, F.lit(position - 1)), substring_from(s, position)
    return F.concat(head, F.regexp_replace(tail, pattern, new))


def title(s: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), substring_from(p, 2))), "")


def like_prefix(s: Column, prefix: str) -> Column:
    """``LIKE 'prefix%'`` with the prefix taken literally; file scans can skip by it."""
    return s.startswith(prefix)
