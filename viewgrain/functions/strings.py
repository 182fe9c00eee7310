"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find(s: Column, sub: str | Column, start: int = 1) -> Column:
    """1-based position of the first occurrence at or after ``start``, 0 if there is none."""
    return F.call_function("locate", _text(sub), s, F.lit(start))


def find_nth(s: Column, sub: str, n: int) -> Column:
    """Position of the n-th occurrence (not overlapping), 0 if there are fewer."""
    occurrences = F.size(F.split(s, _literal(sub), -1)) - 1
    before = F.length(F.substring_index(s, sub, n))
    return F.when(s.isNull(), None).when(occurrences >= n, before + 1).otherwise(0)


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_token(s: Column, delimiter: str, k: int) -> Column:
    """The k-th token, counted from the end if negative; empty text beyond the last."""
    return F.split_part(s, F.lit(delimiter), F.lit(k))


def mid(s: Column, start: int, length: int | None = None) -> Column:
    return F.substring(s, start, length) if length is not None else F.substring(s, start, 2**31 - 1)


def space(n: int) -> Column:
    return F.repeat(F.lit(" "), n)


def join_text(*parts: Column) -> Column:
    """Text addition: NULL if any part is NULL."""
    return F.concat(*parts)


def _text(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x
