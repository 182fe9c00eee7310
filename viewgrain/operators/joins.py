"""Physical joins, deferred relationships, lookups, blends and interval overlaps.

A cartesian product has no operator here; Spark's own ``crossJoin`` says it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.plans.keys import attach_constants, null_safe_join
from viewgrain.plans.ordered import Order, position
from viewgrain.plans.settle import settle

#: Parent, child and their pairs of key columns.
Step = tuple[str, str, list[tuple[str, str]]]
JOIN_KINDS = ("inner", "left", "right", "full")
_TILE_BASE = 4.0


def physical_join(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``{left column: right column}``; the planner picks hash or sort-merge."""
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}")
    on = [left[l] == right[r] for l, r in keys.items()]
    return left.join(right, reduce(Column.__and__, on), how)


@dataclass
class Model:
    """Tables and the relationships between them; a view joins only what it uses."""

    base: str
    tables: dict[str, DataFrame]
    edges: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)
    keep_unmatched: bool = False

    def relate(self, one: str, other: str, keys: Mapping[str, str]) -> Model:
        """Add a relationship on ``{column of one: column of other}``."""
        self.edges.append((one, other, dict(keys)))
        return self

    def view(self, fields: Iterable[str]) -> DataFrame:
        """The base table joined to every table on the way to one of ``fields``.

        Several relationships between the same two tables must all hold. The relationships
        reached first make up a tree; one more between two tables of the view closes a circle
        and must hold as well: it joins the key of whichever table comes later, so no join
        is wider than its result. Where there is a circle and unmatched rows go, tables are
        first reduced to the rows that have partners all along the tree, which is what keeps
        a many-to-many step small. A circle through a table the view does not use is not
        asked for. A field of a table that no relationship reaches is refused. A field of the
        base is taken from there; one that several other tables have is refused unless they
        are related on it.
        """
        fields = list(dict.fromkeys(fields))
        steps, closing = self._steps()
        owners = {f: self._owner(f) for f in fields}
        needed = set(owners.values()) - {self.base}
        lost = needed - {child for _, child, _ in steps}
        if lost:
            raise ValueError(f"no relationship leads from {self.base!r} to {sorted(lost)}")
        for parent, child, _ in reversed(steps):
            if child in needed and parent != self.base:
                needed.add(parent)
        steps = [step for step in steps if step[1] in needed]
        met = needed | {self.base}
        closing = [edge for edge in closing if edge[0] in met and edge[1] in met]
        tables = {name: self.tables[name] for name in met}
        if closing and not self.keep_unmatched:
            tables = _reduced(tables, steps)
        names = {(self.base, c): c for c in tables[self.base].columns}
        joined, there = tables[self.base], {self.base}
        for parent, child, pairs in steps:
            there.add(child)
            on = [(parent, l, r) for l, r in pairs]
            for one, other, more in closing:
                if child == other and one in there:
                    on += [(one, l, r) for l, r in more]
                elif child == one and other in there:
                    on += [(other, r, l) for l, r in more]
            joined = self._attach(joined, names, tables[child], child, on)
        return joined.select(*[F.col(f"`{names[owners[f], f]}`").alias(f) for f in fields])

    def _attach(
        self, joined: DataFrame, names: dict[tuple[str, str], str], right: DataFrame, child: str, on: list[tuple[str, str, str]]
    ) -> DataFrame:
        # A column name that is already there stays with the table joined before.
        taken = {c: f"__{child}_{c}" for c in right.columns if c in joined.columns}
        names |= {(child, c): taken.get(c, c) for c in right.columns}
        right = right.withColumnsRenamed(taken)
        equal = [joined[names[table, l]] == right[names[child, r]] for table, l, r in on]
        how = "left" if self.keep_unmatched else "inner"
        return joined.join(right, reduce(Column.__and__, equal), how)

    def _owner(self, name: str) -> str:
        owners = [table for table, df in self.tables.items() if name in df.columns]
        if not owners:
            raise ValueError(f"no table has a column {name!r}")
        if self.base in owners:
            return self.base
        links = [{one, other} for one, other, keys in self.edges if keys.get(name) == name]
        same = {owners[0]}
        for _ in links:
            same = same.union(*[link for link in links if link & same])
        if not set(owners) <= same:
            raise ValueError(f"{name!r} is a column of several tables: {owners}")
        return owners[0]

    def _steps(self) -> tuple[list[Step], list[Step]]:
        """(parent, child, key pairs) in an order that attaches each table to one joined before,
        and the relationships that close a circle."""
        related: dict[frozenset[str], tuple[str, str, list[tuple[str, str]]]] = {}
        for one, other, keys in self.edges:
            first, _, pairs = related.setdefault(frozenset((one, other)), (one, other, []))
            pairs.extend(keys.items() if first == one else [(r, l) for l, r in keys.items()])
        reached, steps, closing, waiting = {self.base}, [], [], list(related.values())
        while near := [e for e in waiting if e[0] in reached or e[1] in reached]:
            one, other, pairs = near[0]
            waiting.remove(near[0])
            if one in reached and other in reached:
                closing.append((one, other, pairs))
                continue
            if other in reached:
                one, other, pairs = other, one, [(r, l) for l, r in pairs]
            steps.append((one, other, pairs))
            reached.add(other)
        return steps, closing


def _reduced(tables: dict[str, DataFrame], steps: list[Step]) -> dict[str, DataFrame]:
    """The tables without the rows that find no partner along the tree of ``steps``.

    Semi-joins on distinct keys, from the leaves to the base and back; the base itself, the
    largest table as a rule, is only read.
    """
    out = dict(tables)

    def keep(name: str, own: list[str], by: DataFrame, keys: list[str]) -> None:
        marked = [f"__key_{i}" for i in range(len(keys))]
        partners = by.select(*[F.col(f"`{k}`").alias(m) for k, m in zip(keys, marked)]).distinct()
        equal = [out[name][c] == partners[m] for c, m in zip(own, marked)]
        out[name] = out[name].join(partners, reduce(Column.__and__, equal), "left_semi")

    parents = {parent for parent, _, _ in steps}
    base = next((p for p, _, _ in steps if p not in {c for _, c, _ in steps}), None)
    for parent, child, pairs in reversed(steps):
        if parent != base:
            keep(parent, [l for l, _ in pairs], out[child], [r for _, r in pairs])
    for parent, child, pairs in steps:
        if child in parents:  # a leaf meets only rows that join it anyway
            keep(child, [r for _, r in pairs], out[parent], [l for l, _ in pairs])
    return out


def lookup_join(
    fact: DataFrame, dim: DataFrame, keys: Mapping[str, str], check: bool = True
) -> DataFrame:
    """Many-to-one lookup: every fact row once, unmatched ones with NULLs.

    ``check`` verifies that the key is unique in ``dim``, a partial-aggregated count over
    the dimension alone.
    """
    if check:
        doubled = dim.groupBy(*keys.values()).count().where("count > 1").limit(1)
        if not doubled.isEmpty():
            raise ValueError(f"{list(keys.values())} is not unique in the lookup table")
    on = reduce(Column.__and__, [fact[l] == dim[r] for l, r in keys.items()])
    same = [r for l, r in keys.items() if r == l]
    if same:
        marked = dim.withColumnsRenamed({r: f"__dim_{r}" for r in same})
        pairs = [fact[l] == marked[f"__dim_{r}" if r in same else r] for l, r in keys.items()]
        return fact.join(marked, reduce(Column.__and__, pairs), "left").drop(
            *[f"__dim_{r}" for r in same]
        )
    return fact.join(dim, on, "left")


def blend(
    primary: DataFrame, secondary: DataFrame, link: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Aggregate the secondary source to the linking dimensions, then left join it."""
    grouped = secondary.groupBy(*link).agg(*[m.alias(n) for n, m in measures.items()])
    return null_safe_join(primary, grouped, list(link))


def member_rank(df: DataFrame, dim: str, aggregate: Column, name: str) -> DataFrame:
    """Dense rank, largest first, of the members of ``dim`` over an aggregate."""
    totals = settle(df.groupBy(dim).agg(aggregate.alias("__value")))
    levels = position(totals.select("__value").distinct(), [], [Order("__value", True)], name)
    return null_safe_join(totals, levels, ["__value"]).select(dim, F.col(name).cast("int").alias(name))


def join_rank_back(df: DataFrame, dim: str, aggregate: Column, name: str) -> DataFrame:
    """Put the dense rank of each member on its rows."""
    return null_safe_join(df, member_rank(df, dim, aggregate, name), [dim])


def overlap_join(
    df: DataFrame, lo: str, hi: str, by: Sequence[str], key: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Pairs of rows in the same ``by`` group whose half-open intervals overlap.

    Each pair comes once, the row that starts first (then the smaller key) on the left.
    The later start of such a pair lies inside the earlier interval, so the two meet in the
    time tile of that start. The earlier interval is dealt into tiles about as wide as
    itself, never more than a few; the later row looks into its tile at each width that
    occurs, of which there are at most some dozens. A hot group is spread over its tiles,
    and a few very long intervals do not slow the many short ones down.
    """
    columns = list(dict.fromkeys([key, lo, hi, *keep]))
    start, end = F.col(lo).cast("double"), F.col(hi).cast("double")
    # Numbers are subtracted before the cast: large ones may be one and the same double.
    numeric = isinstance(df.schema[lo].dataType, T.NumericType) and isinstance(df.schema[hi].dataType, T.NumericType)
    length = (F.col(hi) - F.col(lo)).cast("double") if numeric else end - start
    power = F.ceil(F.log(length) / math.log(_TILE_BASE)).cast("int")
    base = df.select(*by, *columns).where(F.col(lo) < F.col(hi)).withColumn("__power", power)
    powers = base.agg(F.collect_set("__power").alias("__powers"))

    def tile(instant: Column) -> Column:
        return F.floor(instant / F.pow(F.lit(_TILE_BASE), F.col("__power")))

    left = base.withColumn("__tile", F.explode(F.sequence(tile(start), tile(end)))).select(
        *[F.col(b).alias(f"__by_{i}") for i, b in enumerate(by)],
        F.col("__tile").alias("__left_tile"),
        F.col("__power").alias("__left_power"),
        *[F.col(c).alias(f"{c}_1") for c in columns],
    )
    right = attach_constants(base.drop("__power"), powers)
    right = right.withColumn("__power", F.explode("__powers")).select(
        *by, "__power", tile(start).alias("__tile"), *[F.col(c).alias(f"{c}_2") for c in columns]
    )
    on = [F.col(b).eqNullSafe(F.col(f"__by_{i}")) for i, b in enumerate(by)]
    on += [F.col("__tile") == F.col("__left_tile"), F.col("__power") == F.col("__left_power")]
    starts_first = (F.col(f"{lo}_1") < F.col(f"{lo}_2")) | (
        (F.col(f"{lo}_1") == F.col(f"{lo}_2")) & (F.col(f"{key}_1") < F.col(f"{key}_2"))
    )
    on += [starts_first, F.col(f"{lo}_2") < F.col(f"{hi}_1")]
    joined = right.join(left, reduce(Column.__and__, on), "inner")
    return joined.select(*by, *[f"{c}_{side}" for side in (1, 2) for c in columns])
