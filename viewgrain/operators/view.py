"""The worksheet: dimensions x measures with filters, sort and top-N, and its dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.operators.filters import filter_rows
from viewgrain.plans.keys import attach

Dims = Sequence[str | tuple[str, Column]]

# Encoding channels that add to the grain, and those that hold a measure.
GRAIN_CHANNELS = ("color", "shape", "detail")
MEASURE_CHANNELS = ("size", "label", "text", "angle")


def named(dims: Dims) -> list[tuple[str, Column]]:
    return [(d, F.col(d)) if isinstance(d, str) else d for d in dims]


def detail(df: DataFrame, cols: Sequence[str], filters: Iterable[Column] = ()) -> DataFrame:
    """Raw rows of a disaggregated view; filters and columns reach the scan."""
    return filter_rows(df, filters).select(*cols)


def with_calc(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Inline a row-level calculated field."""
    return df.withColumn(name, expr)


def worksheet(
    df: DataFrame,
    dims: Dims,
    measures: Mapping[str, Column] | None = None,
    filters: Iterable[Column] = (),
    having: Iterable[Column] = (),
    sorts: Sequence[Column] = (),
    top: int | None = None,
    channels: Mapping[str, Mapping[str, Column] | Dims] | None = None,
    preaggregated: bool = False,
) -> DataFrame:
    """Aggregate ``measures`` at the grain of ``dims``.

    ``channels`` adds encodings: color, shape and detail extend the grain, size, label,
    text and angle add measures. Without measures the dimensions are projected as they
    are, without dimensions the result is one row. A ``preaggregated`` source already has
    the grain and is passed through. ``sorts`` with ``top`` becomes a per-task top-k.
    """
    grain, values = named(dims), dict(measures or {})
    for channel, fields in (channels or {}).items():
        if channel in GRAIN_CHANNELS:
            grain += [d for d in named(fields) if d[0] not in dict(grain)]
        elif channel in MEASURE_CHANNELS:
            values.update(fields)
        else:
            raise ValueError(f"unknown channel {channel!r}")
    rows = filter_rows(df, filters)
    keys = [c.alias(n) for n, c in grain]
    if preaggregated:
        out = rows.select(*keys, *values) if values else rows.select(*keys)
    elif not values:
        out = rows.select(*keys)
    elif keys:
        out = rows.groupBy(*keys).agg(*[m.alias(n) for n, m in values.items()])
    else:
        out = rows.agg(*[m.alias(n) for n, m in values.items()])
    out = filter_rows(out, having)
    if sorts:
        out = out.orderBy(*sorts)
    return out.limit(top) if top is not None else out


@dataclass
class OrderOfOperations:
    """One view with every kind of filter, applied in the order a BI tool applies them.

    extract -> data source -> context -> (FIXED values, member filters) -> dimension ->
    (INCLUDE / EXCLUDE values) -> aggregate -> measure filter -> table calculations ->
    table-calculation filter.

    Members and FIXED values therefore see the context filters and not the dimension
    filters. ``fixed``, ``members``, ``include`` and ``table_calcs`` are functions from
    DataFrame to DataFrame, such as partial applications of the operators of this package;
    ``include`` functions get the filtered rows and return a frame keyed by the view's
    dimensions, which is joined to the view.
    """

    dims: Dims
    measures: Mapping[str, Column]
    extract: Sequence[Column] = ()
    source: Sequence[Column] = ()
    context: Sequence[Column] = ()
    fixed: Sequence = ()
    members: Sequence = ()
    dimension: Sequence[Column] = ()
    include: Sequence = ()
    measure: Sequence[Column] = ()
    table_calcs: Sequence = ()
    table_calc_filter: Sequence[Column] = ()
    sorts: Sequence[Column] = field(default_factory=tuple)
    top: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        rows = filter_rows(df, [*self.extract, *self.source, *self.context])
        for add_value in self.fixed:
            rows = add_value(rows)
        in_context = rows
        for keep in self.members:
            rows = keep(rows, in_context)
        rows = filter_rows(rows, self.dimension)
        view = worksheet(rows, self.dims, self.measures)
        names = [n for n, _ in named(self.dims)]
        for add_level in self.include:
            view = attach(view, add_level(rows), names)
        view = filter_rows(view, self.measure)
        for calc in self.table_calcs:
            view = calc(view)
        view = filter_rows(view, self.table_calc_filter)
        if self.sorts:
            view = view.orderBy(*self.sorts)
        return view.limit(self.top) if self.top is not None else view


def manual_order(col: str | Column, members: Sequence) -> Column:
    """Sort key for a hand-made member order; members not listed come last."""
    c = F.col(col) if isinstance(col, str) else col
    place = F.array_position(F.array(*[F.lit(m) for m in members]), c)
    return F.when(place > 0, place).otherwise(F.lit(len(members) + 1))


def top_rows(df: DataFrame, sorts: Sequence[Column], n: int) -> DataFrame:
    """The first n rows under a total order (the row cap of a detail table)."""
    return df.orderBy(*sorts).limit(n)
