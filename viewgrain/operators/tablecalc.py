"""Table calculations on an aggregated view, with explicit partitioning and addressing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.functions.logic import safe_div
from viewgrain.plans import ordered
from viewgrain.plans.keys import attach, group, null_safe_join
from viewgrain.plans.ordered import Order
from viewgrain.plans.settle import is_small, settle

RANK_KINDS = ("rank", "dense", "unique", "modified", "percentile")


def _value(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def compute_using(view_dims: Sequence[str], scope: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(partition, addressing) for a preset.

    ``table`` addresses every dimension, ``cell`` none, ``pane`` all but the first one; a
    list names the addressed dimensions.
    """
    dims = list(view_dims)
    match scope:
        case "table":
            addressed = dims
        case "pane":
            addressed = dims[1:]
        case "cell":
            addressed = []
        case str():
            addressed = [scope]
        case _:
            addressed = list(scope)
    unknown = set(addressed) - set(dims)
    if unknown:
        raise ValueError(f"not dimensions of the view: {sorted(unknown)}")
    return [d for d in dims if d not in addressed], addressed


class Calculations:
    """Any number of table calculations of one addressing, computed in one pass.

    The view is laid out once, however many values are asked for::

        Calculations(view, ["region"], ["month"]).running("sum", "sales", "so_far").lookup("sales", "before", -1).view()
    """

    def __init__(self, view: DataFrame, partition: Sequence[str], order: Sequence[str | Order]):
        self._columns = view.columns
        self._address = ordered.Addressing(view, partition, order)
        self._out: dict[str, Column] = {}

    def window(self, kind: str, value: str | Column, name: str, start: int | None = None, end: int | None = None) -> Calculations:
        """sum, avg, min, max or count over the rows from ``start`` to ``end``; None is open."""
        own = f"__calc_{len(self._out)}"
        if kind == "avg":
            self._address.add(f"{own}_s", "sum", _value(value).cast("double"), start, end)
            self._address.add(f"{own}_n", "count", _value(value), start, end)
            return self._give(name, safe_div(F.col(f"{own}_s"), F.col(f"{own}_n")))
        self._address.add(own, kind, _value(value), start, end)
        return self._give(name, F.col(own))

    def running(self, kind: str, value: str | Column, name: str) -> Calculations:
        return self.window(kind, value, name, None, 0)

    def lookup(self, value: str | Column, name: str, offset: int) -> Calculations:
        """The value ``offset`` rows away; zero is the row itself."""
        own = f"__calc_{len(self._out)}"
        self._address.neighbour(own, _value(value), offset)
        return self._give(name, F.col(own))

    def index(self, name: str) -> Calculations:
        return self._give(name, self._position())

    def first(self, name: str) -> Calculations:
        """0, -1, -2, ... from the first row on."""
        return self._give(name, 1 - self._position())

    def last(self, name: str) -> Calculations:
        """n-1, ..., 0."""
        return self._give(name, self._size() - self._position())

    def size(self, name: str) -> Calculations:
        return self._give(name, self._size())

    def share(self, value: str | Column, name: str) -> Calculations:
        """The value as a part of the partition's sum of it."""
        own = f"__calc_{len(self._out)}"
        self._address.add(own, "sum", _value(value), None, None)
        return self._give(name, safe_div(_value(value), F.col(own)))

    def view(self) -> DataFrame:
        """The view with all values asked for."""
        rows = self._address.view().withColumns(self._out)
        kept = [c for c in self._columns if c not in self._out]
        return rows.select(*[F.col("`" + c.replace("`", "``") + "`") for c in [*kept, *self._out]])

    def _give(self, name: str, value: Column) -> Calculations:
        self._out[name] = value
        return self

    def _position(self) -> Column:
        if not self._address.positions:
            self._address.position("__calc_position")
        return F.col("__calc_position")

    def _size(self) -> Column:
        self._address.add("__calc_size", "count", F.lit(1), None, None)
        return F.col("__calc_size")


def running_value(
    view: DataFrame, kind: str, value: str | Column, name: str, partition, order
) -> DataFrame:
    """Running sum, avg, count, min or max."""
    return Calculations(view, partition, order).running(kind, value, name).view()


def window_value(
    view: DataFrame,
    kind: str,
    value: str | Column,
    name: str,
    partition,
    order,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """sum, avg, min, max or count over the rows from ``start`` to ``end``; None is open."""
    if start is None and end is None and kind != "avg":  # needs no order
        return ordered.per_partition(view, {name: ordered.AGGREGATE[kind](_value(value))}, partition)
    return Calculations(view, partition, order).window(kind, value, name, start, end).view()


def index(view: DataFrame, name: str, partition, order) -> DataFrame:
    return ordered.position(view, partition, order, name)


def size(view: DataFrame, name: str, partition) -> DataFrame:
    return ordered.per_partition(view, {name: F.count(F.lit(1))}, partition)


def first_last(view: DataFrame, first: str, last: str, partition, order) -> DataFrame:
    """FIRST() = 0, -1, -2, ... and LAST() = n-1, ..., 0."""
    return Calculations(view, partition, order).first(first).last(last).view()


def ranks(
    view: DataFrame,
    value: str,
    wanted: Mapping[str, tuple[str, bool]],
    partition: Sequence[str] = (),
) -> DataFrame:
    """Several ranks of one column: ``{name: (kind, ascending)}``, of all kinds but unique.

    Ties are counted, not sorted: the distinct values are ordered once with their row counts,
    all ranks follow from that, and they are joined back together. So a value that many rows
    share is one row of the ordered step.
    """
    partition = list(partition)
    unknown = {k for k, _ in wanted.values()} - set(RANK_KINDS) | {k for k, _ in wanted.values() if k == "unique"}
    if unknown:
        raise ValueError(f"not ranks of a value: {sorted(unknown)}")
    source = view if is_small(view) else settle(view)
    values = source.groupBy(*partition, value).agg(F.count(F.lit(1)).alias("__ties"))
    order = [Order(value, True)]
    laid = Calculations(values, partition, order).running("sum", "__ties", "__through").index("__place")
    laid = laid.window("sum", "__ties", "__rows").size("__values").view()
    above, through, rows = F.col("__through") - F.col("__ties"), F.col("__through"), F.col("__rows")
    out = {}
    for name, (kind, ascending) in wanted.items():
        before = rows - through if ascending else above
        dense = F.col("__values") - F.col("__place") + 1 if ascending else F.col("__place")
        out[name] = {
            "rank": before + 1,
            "modified": before + F.col("__ties"),
            "dense": dense,
            "percentile": F.coalesce(safe_div(before, rows - 1), F.lit(0.0)),
        }[kind]
    ranked = laid.withColumns(out).drop("__ties", "__through", "__place", "__rows", "__values")
    return null_safe_join(source, ranked, [*partition, value])


def rank(
    view: DataFrame,
    value: str,
    name: str,
    kind: str = "rank",
    partition: Sequence[str] = (),
    ascending: bool = False,
    tie_break: Sequence[str | Order] = (),
) -> DataFrame:
    """Rank rows by a column, largest first unless ``ascending``; see ``ranks``."""
    if kind not in RANK_KINDS:
        raise ValueError(f"unknown rank kind {kind!r}")
    if kind == "unique":
        return ordered.position(view, partition, [Order(value, not ascending), *tie_break], name)
    return ranks(view, value, {name: (kind, ascending)}, partition)


def lookup(view: DataFrame, value: str | Column, name: str, offset: int, partition, order) -> DataFrame:
    """The value ``offset`` rows away; zero is the row itself."""
    if offset == 0:
        return view.withColumn(name, _value(value))
    return ordered.neighbour(view, {name: _value(value)}, partition, order, offset)


def total(
    view: DataFrame, rows: DataFrame, aggregate: Column, name: str, partition: Sequence[str]
) -> DataFrame:
    """TOTAL: the aggregate computed again from the rows at the grain of the partition."""
    partition = list(partition)
    return attach(view, group(rows, partition, aggregate.alias(name)), partition)


def percent_of_total(view: DataFrame, value: str, name: str, partition: Sequence[str]) -> DataFrame:
    summed = ordered.per_partition(view, {"__total": F.sum(value)}, partition)
    return summed.withColumn(name, safe_div(F.col(value), F.col("__total"))).drop("__total")


def previous_value(
    view: DataFrame,
    name: str,
    partition,
    order,
    seed: float = 0.0,
    add: str | Column | None = None,
    multiply: str | Column | None = None,
) -> DataFrame:
    """``multiply * PREVIOUS_VALUE(seed) + add``, the self-referring forms that compose."""
    b = F.lit(0.0) if add is None else _value(add)
    if multiply is None:  # a running sum, NULL from the first NULL on
        b = b.cast("double")
        parts = {"__sum": ("sum", b), "__gaps": ("sum", F.when(b.isNull(), 1).otherwise(0))}
        summed = ordered.running(view, parts, partition, order)
        value = F.when(F.col("__gaps") == 0, F.col("__sum") + float(seed))
        return summed.withColumn(name, F.nullif(value, F.lit(float("nan")))).drop(*parts)
    a = _value(multiply)
    return ordered.fold_affine(view, name, a, b, seed, partition, order)


def table_calc_filter(view: DataFrame, keep: Column) -> DataFrame:
    """Hide rows after the table calculations have seen them."""
    return view.where(keep)

