"""Patterns with wildcards, case, and stored dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any text, one character, and what takes a wildcard as itself.
ANY, ONE, ESCAPE = "*", "?", "\\"


def like_pattern(pattern: str) -> str:
    """A pattern with * and ? as one of SQL LIKE with the escape character \\."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == ESCAPE and k + 1 < len(pattern):
            k += 1
            c = pattern[k]
            out.append(ESCAPE + c if c in "%_\\" else c)
        elif c == ANY:
            out.append("%")
        elif c == ONE:
            out.append("_")
        else:
            out.append(ESCAPE + c if c in "%_\\" else c)
        k += 1
    return "".join(out)


def matches(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    if ignore_case:
        column, pattern = F.lower(column), pattern.lower()
    return column.like(like_pattern(pattern))


def matches_name(name: str, pattern: str) -> bool:
    """The same for a name on the driver."""
    import re

    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == ESCAPE and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(".*" if c == ANY else "." if c == ONE else re.escape(c))
        k += 1
    return re.fullmatch("".join(out), name, re.S) is not None


def stored_date(column: Column) -> Column:
    """A compact date text (YYYYMMDDhhmmss with a fraction, or the front of it) as a timestamp without zone.

    Missing months and days are the first, missing times zero; null where the text is no date.
    """
    digits = F.regexp_extract(column, r"^\s*(\d{4,})\s*$", 1)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)))
    text = F.concat(F.substring(full, 1, 14), F.lit("."), F.rpad(F.substring(full, 15, 6), 6, "0"))
    return F.when(F.length(digits) >= 4, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss.SSSSSS"))).cast("timestamp_ntz")
