"""Reference lines, distribution bands and trend lines on a view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewgrain.operators.aggregates import percentiles
from viewgrain.plans.keys import attach, group
from viewgrain.plans.ordered import per_partition
from viewgrain.plans.settle import is_small, settle

_STATS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def scope_dims(view_dims: Sequence[str], scope: str) -> list[str]:
    """``table`` is one scope, ``pane`` one per member of the first dimension, ``cell`` one per row."""
    match scope:
        case "table":
            return []
        case "pane":
            return list(view_dims)[:1]
        case "cell":
            return list(view_dims)
    raise ValueError(f"unknown scope {scope!r}")


def reference_line(
    view: DataFrame,
    view_dims: Sequence[str],
    measure: str,
    stat: str | float,
    scope: str = "table",
    name: str = "reference",
) -> DataFrame:
    """A constant, or the avg / median / min / max / sum of the measure in each scope."""
    if not isinstance(stat, str):
        return view.withColumn(name, F.lit(float(stat)))
    dims = scope_dims(view_dims, scope)
    if stat == "median":
        source = view if is_small(view) else settle(view)
        return attach(source, percentiles(source, dims, {name: (measure, 0.5)}), dims)
    return per_partition(view, {name: _STATS[stat](measure)}, dims)


def distribution_band(
    view: DataFrame,
    view_dims: Sequence[str],
    measure: str,
    low: float,
    high: float,
    scope: str = "table",
) -> DataFrame:
    """Two percentiles of the measure per scope, as ``band_low`` and ``band_high``."""
    dims = scope_dims(view_dims, scope)
    source = view if is_small(view) else settle(view)
    bounds = percentiles(source, dims, {"band_low": (measure, low), "band_high": (measure, high)})
    return attach(source, bounds, dims)


def trend_line(view: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group: slope, intercept, r2 and the fitted value of each row."""
    by = list(by)
    source = view if is_small(view) else settle(view)
    line = group(
        source,
        by,
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    return attach(source, line, by).withColumn("fitted", fitted)
