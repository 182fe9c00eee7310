"""Level-of-detail values: FIXED, INCLUDE, EXCLUDE and their nesting.

Every value is a grouped aggregate joined back, not a window. Grouping combines map-side,
so a member that holds a third of the rows never lands in one task, and DISTINCT works.
When the source is large the grouped result is settled first: the planner then knows its
size, and joins a small one without shuffling the source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.functions.logic import safe_div
from viewgrain.operators.view import Dims, named, worksheet
from viewgrain.plans.keys import attach, group
from viewgrain.plans.settle import is_small, settle


def _grouped(df: DataFrame, dims: list[str], values: Mapping[str, Column]) -> DataFrame:
    out = group(df, dims, *[v.alias(n) for n, v in values.items()])
    return out if is_small(df) else settle(out)


def fixed(df: DataFrame, dims: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Put aggregates at the grain of ``dims`` on every row; no dims means the whole table.

    ``df`` should carry the context filters and not the dimension filters.
    """
    dims = list(dims)
    return attach(df, _grouped(df, dims, values), dims)


def include(
    df: DataFrame, view_dims: Dims, extra: Dims, inner: Column, outer, name: str
) -> DataFrame:
    """Aggregate at view + extra, then re-aggregate with ``outer(Column)`` to the view."""
    fine = worksheet(df, [*view_dims, *extra], {"__inner": inner})
    names = [n for n, _ in named(view_dims)]
    return group(fine, names, outer(F.col("__inner")).alias(name))


def exclude(
    df: DataFrame,
    view_dims: Dims,
    drop: Sequence[str],
    value: Column,
    name: str,
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The view with an aggregate at the grain of its dimensions minus ``drop``."""
    view = worksheet(df, view_dims, {**(measures or {}), "__rows": F.count(F.lit(1))}).drop("__rows")
    kept = [d for d in named(view_dims) if d[0] not in drop]
    coarse = worksheet(df, kept, {name: value})
    return attach(view, coarse, [n for n, _ in kept])


def fixed_in_view(
    df: DataFrame,
    view_dims: Sequence[str],
    fixed_dims: Sequence[str],
    inner: Column,
    outer,
    name: str,
) -> DataFrame:
    """Aggregate a FIXED value in a view: each fixed member counts once per view cell."""
    view_dims, fixed_dims = list(view_dims), list(fixed_dims)
    values = _grouped(df, fixed_dims, {"__fixed": inner})
    members = df.select(*dict.fromkeys([*view_dims, *fixed_dims])).distinct()
    return group(attach(members, values, fixed_dims), view_dims, outer(F.col("__fixed")).alias(name))


@dataclass(frozen=True)
class Level:
    """A value at the grain of ``dims``: sum, count, min, max or avg of ``value``.

    In a view that lacks some of the dims, ``outer`` (one of the same) aggregates it again,
    each of its members counting once per cell.
    """

    dims: tuple[str, ...]
    kind: str
    value: str
    outer: str | None = None


_PARTS = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}
_AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}
_AGAIN = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def levels(df: DataFrame, view_dims: Dims, wanted: Mapping[str, Level]) -> DataFrame:
    """The view at ``view_dims`` with any number of values at grains of their own.

    The source is read once, into a settled table at the union of all grains. From there
    every grain is rolled up from the smallest one above it that is there already, as sums,
    counts and extremes of parts are those of the whole. COUNTD and percentiles are not, and
    are refused. Dimensions that a level names and the view does not are columns of ``df``.
    """
    view = [n for n, _ in named(view_dims)]
    unknown = {k for level in wanted.values() for k in (level.kind, level.outer) if k is not None} - set(_PARTS)
    if unknown:
        raise ValueError(f"not aggregates that add up: {sorted(unknown)}")
    extra = [d for level in wanted.values() for d in level.dims if d not in view]
    finest = [*view, *dict.fromkeys(extra)]
    parts = {(p, level.value): i for i, (p, level) in enumerate((p, lv) for lv in wanted.values() for p in _PARTS[lv.kind])}
    values = [F.col(f"`{v}`").alias(f"__of_{v}") for v in dict.fromkeys(v for _, v in parts)]
    base = df.select(*[c.alias(n) for n, c in named([*view_dims, *dict.fromkeys(extra)])], *values)
    grains = {frozenset(finest): settle(group(base, finest, *[_AGGREGATE[p](f"__of_{v}").alias(f"__p{i}") for (p, v), i in parts.items()]))}

    def grain(dims: Sequence[str]) -> DataFrame:
        want = frozenset(dims)
        if want not in grains:
            above = min((g for g in grains if g > want), key=len)
            again = [_AGAIN[p](f"__p{i}").alias(f"__p{i}") for (p, _), i in parts.items()]
            grains[want] = settle(group(grains[above], [d for d in finest if d in want], *again))
        return grains[want]

    def value(level: Level) -> Column:
        own = [F.col(f"__p{parts[p, level.value]}") for p in _PARTS[level.kind]]
        return safe_div(own[0].cast("double"), own[1]) if level.kind == "avg" else own[0]

    # The finest first, so that each is there for those below it.
    for level in sorted(wanted.values(), key=lambda lv: -len(lv.dims)):
        grain(level.dims)
    out = grain(view).select(*view)
    for name, level in wanted.items():
        dims = [d for d in finest if d in level.dims]
        at = grain(dims).select(*dims, value(level).alias(name))
        if set(dims) <= set(view):
            out = attach(out, at, dims)
            continue
        if level.outer is None:
            raise ValueError(f"{name!r} is finer than the view and needs an outer aggregate")
        cells = grain([*view, *dims]).select(*[d for d in finest if d in {*view, *dims}])
        again = attach(cells, at.withColumnRenamed(name, "__fixed"), dims)
        out = attach(out, group(again, view, _AGGREGATE[level.outer]("__fixed").alias(name)), view)
    return out


def nested(
    df: DataFrame, steps: Sequence[tuple[Sequence[str], Mapping[str, Column]]]
) -> DataFrame:
    """Aggregates of aggregates: each step groups the result of the one before."""
    for dims, values in steps:
        df = group(df, list(dims), *[v.alias(n) for n, v in values.items()])
    return df


def cohort(df: DataFrame, member: str, date: str, name: str) -> DataFrame:
    """Put each member's first date on its rows, for use as a dimension."""
    return fixed(df, [member], {name: F.min(date)})
