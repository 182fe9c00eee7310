"""Distinct counts and quantiles that are stored once and aggregated to any grain later.

A sketch is a few kilobytes that stand for a set or a distribution of any size. Sketches of
parts merge into that of the whole, so a table of them at a fine grain answers every coarser
one without the rows, which an approximate aggregate cannot: its result does not add up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.plans.keys import group

#: Buckets of a distinct sketch as a power of two: a standard error near 0.8 %.
LOG_BUCKETS = 14
#: Size of a quantile sketch: a rank error near 0.7 %.
QUANTILE_SIZE = 400


def sketched(
    df: DataFrame, dims: Sequence[str], distinct: Mapping[str, str], quantiles: Mapping[str, str]
) -> DataFrame:
    """One row per ``dims`` with a distinct sketch and a quantile sketch per ``{name: column}``.

    The rows are combined map-side, so a hot group ships one sketch per task.
    """
    sets = [F.hll_sketch_agg(F.col(f"`{c}`"), LOG_BUCKETS).alias(n) for n, c in distinct.items()]
    spreads = [F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), QUANTILE_SIZE).alias(n) for n, c in quantiles.items()]
    return group(df, list(dims), *sets, *spreads)


def merged(stored: DataFrame, dims: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """The sketches of a stored table, merged to the grain of ``dims``."""
    sets = [F.hll_union_agg(n, F.lit(False)).alias(n) for n in distinct]
    return group(stored, list(dims), *sets, *[F.kll_merge_agg_double(n).alias(n) for n in quantiles])


def distinct_of(sketch: str | Column) -> Column:
    """The estimated number of different values."""
    return F.hll_sketch_estimate(sketch)


def quantile_of(sketch: str | Column, p: float) -> Column:
    """A value at about the rank ``p``."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))
