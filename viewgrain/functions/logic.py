"""Logic, conversion and division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """Ratio as a double, NULL when the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def iif(condition: Column, yes, no=None, unknown=None) -> Column:
    """Three-way IIF: ``unknown`` is the result when the condition is NULL."""
    out = F.when(condition, yes)
    return out.when(condition.isNull(), unknown).otherwise(no) if unknown is not None else out.otherwise(no)


def zn(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def to_int(x: Column) -> Column:
    """Whole number, truncated toward zero; text such as ``3.7`` counts, other text is NULL.

    Whole numbers, also as text, are exact over the full range of a bigint.
    """
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_date(x: Column) -> Column:
    return x.try_cast("date")


def to_datetime(x: Column) -> Column:
    return x.try_cast("timestamp")


def to_text(x: Column) -> Column:
    return x.cast("string")
