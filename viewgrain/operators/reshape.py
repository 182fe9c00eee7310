"""Unpivot, crosstab, unions and member-set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.operators.filters import keep_members, rank_members
from viewgrain.plans.keys import group, null_safe_join


def metric_label(name: str) -> str:
    return name.replace("_", " ")


def _wide(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return group(
        df, list(dims), *[m.cast("double").alias(metric_label(n)) for n, m in measures.items()]
    )


def _long(wide: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    labels = [F.col(f"`{metric_label(n)}`") for n in measures]
    return wide.unpivot([F.col(f"`{d}`") for d in dims], labels, "Metric", "Value")


def measure_shape(chart: str, dims: Sequence[str], measures: Sequence[str], measure_names: bool, geo: Sequence[str] = ()) -> str:
    """How a view of several measures is laid out: ``wide``, ``pivot`` or ``geo_bar``.

    With the names of two or more measures on a shelf and a dimension beside them, they
    become rows and a pivot shows them (``unpivot_measures``). A map of two or more measures
    becomes bars over its dimensions other than ``geo``, the coordinates (``unpivot_top``).
    All else stays as wide as it is; one measure is never unpivoted.
    """
    if len(measures) < 2:
        return "wide"
    if measure_names and dims:
        return "pivot"
    if chart == "map" and [d for d in dims if d not in geo]:
        return "geo_bar"
    return "wide"


def measures_view(
    df: DataFrame,
    chart: str,
    dims: Sequence[str],
    measures: Mapping[str, Column],
    measure_names: bool = False,
    geo: Sequence[str] = (),
    top: int = 15,
) -> DataFrame:
    """The rows of a view of several measures in the layout that ``measure_shape`` names."""
    shape = measure_shape(chart, dims, list(measures), measure_names, geo)
    if shape == "pivot":
        return unpivot_measures(df, dims, measures)
    if shape == "geo_bar":
        return unpivot_top(df, [d for d in dims if d not in geo], measures, top)
    return group(df, list(dims), *[m.alias(n) for n, m in measures.items()])


def unpivot_measures(
    df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """(dims, Metric, Value) with one row per listed measure.

    The source is aggregated once, wide, and the result is unpivoted; a measure that is
    NULL in a cell keeps its row.
    """
    return _long(_wide(df, dims, measures), dims, measures)


def unpivot_top(
    df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column], n: int
) -> DataFrame:
    """Unpivoted measures for the ``n`` members of the first dimension with the largest sum
    of all measures; the members are chosen once for all measures."""
    wide = _wide(df, dims, measures)
    if len(dims) == 1:
        # The cells are the members: the first n of them need no second pass and no join.
        total = reduce(Column.__add__, [F.col(f"`{metric_label(m)}`") for m in measures])
        first = wide.orderBy(total.desc_nulls_last(), F.col(dims[0]).asc_nulls_first()).limit(n)
        return _long(first, dims, measures)
    total = reduce(Column.__add__, [m.cast("double") for m in measures.values()])
    members = rank_members(df, dims[0], total, n, ties="strict")
    return keep_members(_long(wide, dims, measures), dims[0], members.select(dims[0]))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column whose types differ becomes double if all are numeric, else text."""
    casts = {}
    for name in frames[0].columns:
        kinds = {f.schema[name].dataType for f in frames}
        if len(kinds) > 1:
            numeric = all(isinstance(k, T.NumericType) for k in kinds)
            casts[name] = "double" if numeric else "string"
    aligned = [f.withColumns({n: F.col(f"`{n}`").cast(t) for n, t in casts.items()}) for f in frames]
    return reduce(DataFrame.unionByName, aligned)


def select_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def combine_sets(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Member sets: ``all`` (either), ``shared`` (both), ``minus`` (first without second)."""
    match op:
        case "all":
            return a.union(b).distinct()
        case "shared":
            return a.intersect(b)
        case "minus":
            return a.subtract(b)
    raise ValueError(f"unknown set operation {op!r}")


def crosstab(
    df: DataFrame,
    rows: Sequence[str],
    col: str,
    measure: Column,
    values: Sequence,
) -> DataFrame:
    """One column per member of ``col`` in ``values``; all others are left to a plain groupBy."""
    return df.groupBy(*rows).pivot(col, list(values)).agg(measure)


def recode(df: DataFrame, col: str, aliases: Mapping) -> DataFrame:
    """Show the alias of a stored value, or the value itself."""
    if not aliases:
        return df
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    c = F.col(col)
    return df.withColumn(col, F.when(c.isNull(), c).otherwise(F.coalesce(F.try_element_at(table, c), c)))


def recode_from(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """``recode`` with the (value, alias) pairs in a table of any size.

    A value that is listed more than once takes the smallest of its aliases, so no row doubles.
    """
    value, alias = aliases.columns
    named = aliases.groupBy(F.col(value).alias(col)).agg(F.min(alias).alias("__alias"))
    joined = null_safe_join(df, named, [col])
    return joined.withColumn(col, F.coalesce("__alias", col)).drop("__alias")


def group_members(
    df: DataFrame, col: str, groups: Mapping[str, Sequence], name: str, other: str | None = None
) -> DataFrame:
    """Ad-hoc groups of members; a member of none keeps its own name or becomes ``other``."""
    out = F
    for label, members in groups.items():
        out = out.when(F.col(col).isin(list(members)), F.lit(label))
    rest = F.col(col).cast("string") if other is None else F.lit(other)
    return df.withColumn(name, out.otherwise(rest) if groups else rest)


def set_flag(df: DataFrame, col: str, members: DataFrame, name: str) -> DataFrame:
    """Whether each row's member is in the set."""
    marked = members.select(F.col(members.columns[0]).alias(col)).distinct()
    joined = null_safe_join(df, marked.withColumn("__in", F.lit(True)), [col])
    return joined.withColumn(name, F.col("__in").isNotNull()).drop("__in")
