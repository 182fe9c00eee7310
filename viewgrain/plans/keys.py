"""Joins on keys in which NULL is a member like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the key columns of ``left`` are kept.

    No broadcast hint is given: the planner broadcasts a side whose size it knows to be
    under its threshold, and adaptive execution splits a hot key otherwise.
    """
    if not keys:
        raise ValueError("at least one key is needed; see attach_constants for none")
    marked = {k: f"__key_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(marked)
    on = [left[k].eqNullSafe(renamed[marked[k]]) for k in keys]
    joined = left.join(renamed, reduce(Column.__and__, on), how)
    return joined.drop(*marked.values())


def attach_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate on every row, as one scalar subquery."""
    values = one_row.select(F.struct(*one_row.columns).alias("__values")).scalar()
    return df.withColumns({name: values[name] for name in one_row.columns})


def attach(df: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group values, or the single global row when ``keys`` is empty."""
    return null_safe_join(df, grouped, keys) if keys else attach_constants(df, grouped)


def group(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
