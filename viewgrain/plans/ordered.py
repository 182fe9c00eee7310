"""Ordered calculations whose partitions may be larger than one task.

A Spark window puts a whole partition in one task. That is right for a small view and
wrong for a ranking of a billion members. So a view is written once and its rows counted.
Up to ``spark.viewgrain.blockRows`` one plain window gives all values. Beyond it
the rows are range-partitioned on (partition, order), which cuts a hot partition into
blocks of bounded size; each block is computed alone and then shifted by what the earlier
blocks of its partition add up to. ``Addressing`` shares one such layout among any number of
calculations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.plans.keys import attach, group, null_safe_join
from viewgrain.plans.settle import block_rows, is_small, settle

#: Most blocks a view is cut into.
MOST_BLOCKS = 10_000
BLOCK = "__block"
POSITION = "__position"
_UNSORTABLE = (T.MapType, T.VariantType)


@dataclass(frozen=True)
class Order:
    """One sort key of an addressing order."""

    column: str
    descending: bool = False

    def reversed(self) -> Order:
        return Order(self.column, not self.descending)

    def sort(self) -> Column:
        c = F.col(_quoted(self.column))
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_order(order: Sequence[str | Order]) -> list[Order]:
    """Turn ``["month", "-total"]`` into sort keys; a leading minus means descending."""
    keys = []
    for item in order:
        if isinstance(item, Order):
            keys.append(item)
        else:
            keys.append(Order(item[1:], True) if item.startswith("-") else Order(item))
    return keys


def total_order(df: DataFrame, partition: Sequence[str], order: Sequence[str | Order]) -> list[Order]:
    """``order`` followed by every other sortable column, so that ties have one outcome."""
    keys = as_order(order)
    if not keys:
        raise ValueError("an ordered calculation needs an order")
    used = {k.column for k in keys} | set(partition)
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in used and not isinstance(f.dataType, _UNSORTABLE)
    ]
    return keys + [Order(name) for name in rest]


@dataclass
class Blocks:
    """A view and the way its rows are cut: ``cut`` is False when one window will do."""

    rows: DataFrame
    partition: list[str]
    order: list[Order]
    cut: bool

    @property
    def scope(self) -> list[str]:
        return self.partition + [BLOCK] if self.cut else self.partition

    def window(self) -> W:
        keys = [k.sort() for k in self.order]
        return W.partitionBy(*[_quoted(c) for c in self.scope]).orderBy(*keys)


def lay_out(df: DataFrame, partition: Sequence[str], order: Sequence[str | Order]) -> Blocks:
    """Write the view once and decide from its true row count whether it must be cut.

    There are at most ``MOST_BLOCKS`` blocks, whatever the rows, so a table with a row per
    block stays small; beyond that the blocks grow, and Spark sorts them with spilling.
    """
    partition = list(partition)
    keys = total_order(df, partition, order)
    limit = block_rows(df.sparkSession)
    kept = settle(df)
    n = kept.count()
    if n <= limit:
        return Blocks(kept, partition, keys, cut=False)
    ranges = [F.col(_quoted(c)).asc_nulls_first() for c in partition] + [k.sort() for k in keys]
    cut = kept.repartitionByRange(min(-(-n // limit), MOST_BLOCKS), *ranges).withColumn(BLOCK, F.spark_partition_id())
    return Blocks(settle(cut), partition, keys, cut=True)


AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
#: How the results of an aggregate over several pieces are merged.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_COMBINE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


@dataclass(frozen=True)
class Frame:
    """An aggregate over the rows from ``start`` to ``end`` around each row; None is open."""

    kind: str
    value: Column
    start: int | None
    end: int | None

    @property
    def width(self) -> int | None:
        return None if self.start is None or self.end is None else self.end - self.start + 1


class Addressing:
    """The rows of a view in one order, laid out once, and any number of values on them.

    A small view takes one window that gives all values. A larger one is range-cut and
    written once. Then

    * running values, positions and totals of the partition come from one window in each
      block and one table of block totals, shifted by the blocks before (or after) it;
    * short frames are computed in tiles of consecutive positions, a row near an edge also
      going to the neighbouring tile that needs it;
    * a frame wider than a tile is the end of one tile, all of some tiles and the beginning
      of another: aggregates from each row to the ends of its tile and a table of tile
      totals give it, so no task ever holds the frame;
    * values of another row, and of open frames that end there, are joined by position.
    """

    def __init__(self, view: DataFrame, partition: Sequence[str], order: Sequence[str | Order]):
        self.columns = view.columns
        self.blocks = lay_out(view, partition, order)
        self.frames: dict[str, Frame] = {}
        self.lookups: dict[str, tuple[Column, int]] = {}
        self.positions: list[str] = []

    def add(self, name: str, kind: str, value: Column, start: int | None, end: int | None) -> Addressing:
        if kind not in AGGREGATE:
            raise ValueError(f"unknown aggregate {kind!r}")
        self.frames[name] = Frame(kind, value, start, end)
        return self

    def position(self, name: str) -> Addressing:
        """Number the rows of each partition from 1, as ``row_number`` does."""
        self.positions.append(name)
        return self

    def neighbour(self, name: str, value: Column, offset: int) -> Addressing:
        """The value found ``offset`` rows further on (negative: further back)."""
        self.lookups[name] = (value, offset)
        return self

    def view(self) -> DataFrame:
        """The rows with all values asked for so far."""
        names = [*self.frames, *self.lookups, *self.positions]
        kept = [c for c in self.columns if c not in names]
        rows = self._cut() if self.blocks.cut else self._plain()
        return rows.select(*[_quoted(c) for c in [*kept, *names]])

    def _plain(self) -> DataFrame:
        window = self.blocks.window()
        out = {
            n: AGGREGATE[f.kind](f.value).over(window.rowsBetween(*_bounds(f.start, f.end))) for n, f in self.frames.items()
        }
        out |= {n: F.lead(v, offset).over(window) for n, (v, offset) in self.lookups.items()}
        out |= {n: F.row_number().over(window).cast("long") for n in self.positions}
        return self.blocks.rows.withColumns(out)

    def _cut(self) -> DataFrame:
        tile = block_rows(self.blocks.rows.sparkSession)
        ids = {n: i for i, n in enumerate(self.frames)}
        near, far, wide = {}, {}, {}
        for n, f in self.frames.items():
            if f.width is None:
                continue
            if f.width > tile:
                wide[n] = f
            elif max(abs(f.start), abs(f.end)) <= tile:
                near[n] = f
            else:
                far[n] = f
        rows = self._running(ids).drop(BLOCK)
        if near or far:  # a far frame is that of the row it begins at
            frames = {f"__near{ids[n]}": f for n, f in near.items()}
            frames |= {f"__own{ids[n]}": Frame(f.kind, f.value, 0, f.width - 1) for n, f in far.items()}
            rows = self._in_tiles(rows, frames, tile)
        if wide:
            rows = self._tile_ends(rows, wide, ids, tile)
        rows = rows.withColumns({f"__look{i}": v for i, (v, _) in enumerate(self.lookups.values())})

        # What each offset brings from the row there, fetched by one join per offset.
        fetched: dict[int, set[str]] = {}
        for n, f in self.frames.items():
            i = ids[n]
            if f.end not in (None, 0) and n not in near:
                fetched.setdefault(f.end, set()).add(f"__to{i}")
            if f.start not in (None, 0) and n not in near:
                fetched.setdefault(f.start, set()).add(f"__from{i}")
            if n in far:
                fetched.setdefault(f.start, set()).add(f"__own{i}")
            if n in wide:
                fetched.setdefault(f.start, set()).update({f"__rest{i}", f"__less{i}", f"__more{i}"})
                fetched.setdefault(f.end, set()).add(f"__begun{i}")
        for i, (_, offset) in enumerate(self.lookups.values()):
            fetched.setdefault(offset, set()).add(f"__look{i}")
        partition, out = self.blocks.partition, rows
        for offset, wanted in fetched.items():
            if offset:
                there = rows.select(
                    *[_quoted(c) for c in partition], (F.col(POSITION) - offset).alias(POSITION),
                    *[F.col(c).alias(_at(c, offset)) for c in sorted(wanted)],
                )
                out = null_safe_join(out, there, [*partition, POSITION])
        values = {n: self._value(n, ids[n], n in near, n in far, n in wide, tile) for n in self.frames}
        values |= {n: F.col(_at(f"__look{i}", offset)) for i, (n, (_, offset)) in enumerate(self.lookups.items())}
        values |= {n: F.col(POSITION) for n in self.positions}
        return out.withColumns(values)

    def _value(self, name: str, i: int, near: bool, far: bool, wide: bool, tile: int) -> Column:
        f = self.frames[name]
        if near:
            return F.col(f"__near{i}")
        empty = F.lit(0) if f.kind == "count" else F.lit(None)
        whole, size = F.col(f"__all{i}"), F.col(_SIZE)
        first = F.lit(1) if f.start is None else F.col(POSITION) + f.start
        last = size if f.end is None else F.col(POSITION) + f.end
        to = whole if f.end is None else F.col(_at(f"__to{i}", f.end))
        since = whole if f.start is None else F.col(_at(f"__from{i}", f.start))
        if far:
            inside = F.col(_at(f"__own{i}", f.start))
        elif wide:
            rest, begun = F.col(_at(f"__rest{i}", f.start)), F.col(_at(f"__begun{i}", f.end))
            apart = F.floor((last - 1) / tile) - F.floor((first - 1) / tile)
            between = F.when(apart == (f.width - 1) // tile, F.col(_at(f"__less{i}", f.start))).otherwise(
                F.col(_at(f"__more{i}", f.start))
            )
            combine = _COMBINE[f.kind]
            inside = combine(combine(rest, between), begun).cast(self._type(f))
        else:
            inside = since if f.end is None else to
        return (
            F.when((last < 1) | (first > size), empty)
            .when((first <= 1) & (last >= size), whole)
            .when(first <= 1, to)
            .when(last >= size, since)
            .otherwise(inside)
        )

    def _type(self, f: Frame) -> T.DataType:
        return self.blocks.rows.select(AGGREGATE[f.kind](f.value)).schema[0].dataType

    def _running(self, ids: dict[str, int]) -> DataFrame:
        """Rows with their position, the size of the partition, and for each frame the
        aggregates of the whole partition, up to the row and from the row on."""
        blocks = self.blocks
        names = [_quoted(c) for c in blocks.partition]
        open_ = {n: f for n, f in self.frames.items() if not (f.width is not None and self._is_near(f))}
        ahead = blocks.window().rowsBetween(W.unboundedPreceding, 0)
        behind = W.partitionBy(*[_quoted(c) for c in blocks.scope]).orderBy(*[k.reversed().sort() for k in blocks.order])
        behind = behind.rowsBetween(W.unboundedPreceding, 0)
        inner, parts = {POSITION: F.count(F.lit(1)).over(ahead)}, [F.count(F.lit(1)).alias("__n")]
        for n, f in open_.items():
            i, agg = ids[n], AGGREGATE[f.kind](f.value)
            if f.end is not None:
                inner[f"__to{i}"] = agg.over(ahead)
            if f.start is not None:
                inner[f"__from{i}"] = agg.over(behind)
            parts.append(agg.alias(f"__part{i}"))
        rows = blocks.rows.withColumns(inner)
        per_block = blocks.rows.groupBy(*[_quoted(c) for c in blocks.scope]).agg(*parts)
        own = W.partitionBy(*names).orderBy(BLOCK)
        every = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        earlier, later = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(1, W.unboundedFollowing)
        sums = [F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias(_SIZE)]
        for n, f in open_.items():
            i, merge = ids[n], _MERGE[f.kind](f"__part{ids[n]}")
            sums += [merge.over(w).alias(f"__{at}{i}") for w, at in ((earlier, "before"), (later, "after"))]
            sums.append(merge.over(every).cast(self._type(f)).alias(f"__all{i}"))
        joined = null_safe_join(rows, per_block.select(*[_quoted(c) for c in blocks.scope], *sums), blocks.scope)
        out = {POSITION: F.col(POSITION) + F.col("__before")}
        for n, f in open_.items():
            i, combine, kind = ids[n], _COMBINE[f.kind], self._type(f)
            # A sum of sums is a wider decimal than the sum that one window gives.
            if f.end is not None:
                out[f"__to{i}"] = combine(F.col(f"__to{i}"), F.col(f"__before{i}")).cast(kind)
            if f.start is not None:
                out[f"__from{i}"] = combine(F.col(f"__from{i}"), F.col(f"__after{i}")).cast(kind)
        return joined.withColumns(out)

    def _is_near(self, f: Frame) -> bool:
        tile = block_rows(self.blocks.rows.sparkSession)
        return f.width <= tile and max(abs(f.start), abs(f.end)) <= tile

    def _tile_window(self) -> W:
        return W.partitionBy(*[_quoted(c) for c in self.blocks.partition], TILE)

    def _in_tiles(self, rows: DataFrame, frames: dict[str, Frame], tile: int) -> DataFrame:
        """Frames no wider than a tile, whose rows are in the tile or the one beside it."""
        ahead = max(0, *[f.end for f in frames.values()])
        behind = min(0, *[f.start for f in frames.values()])
        place = F.col(POSITION) - 1
        tiles = F.sequence(F.floor((place - ahead) / tile), F.floor((place - behind) / tile))
        spread = rows.withColumn(TILE, F.explode(tiles))
        window = self._tile_window().orderBy(POSITION)
        computed = spread.withColumns(
            {n: AGGREGATE[f.kind](f.value).over(window.rowsBetween(f.start, f.end)) for n, f in frames.items()}
        )
        return computed.where(F.col(TILE) == F.floor(place / tile)).drop(TILE)

    def _tile_ends(self, rows: DataFrame, wide: dict[str, Frame], ids: dict[str, int], tile: int) -> DataFrame:
        """From each row to the end of its tile (rest), to it from the beginning (begun), and
        the tiles after it that a frame from here covers whole: as few (less), or one more."""
        partition = self.blocks.partition
        tiled = rows.withColumn(TILE, F.floor((F.col(POSITION) - 1) / tile))
        begun = self._tile_window().orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)
        rest = self._tile_window().orderBy(F.desc(POSITION)).rowsBetween(W.unboundedPreceding, 0)
        inner, parts, between = {}, [], []
        following = W.partitionBy(*[_quoted(c) for c in partition]).orderBy(TILE)
        for n, f in wide.items():
            i, agg = ids[n], AGGREGATE[f.kind](f.value)
            inner |= {f"__begun{i}": agg.over(begun), f"__rest{i}": agg.over(rest)}
            parts.append(agg.alias(f"__tile{i}"))
            apart = (f.width - 1) // tile
            for name, whole in (("less", apart - 1), ("more", apart)):
                merged = _MERGE[f.kind](f"__tile{i}")
                value = merged.over(following.rowsBetween(1, whole)) if whole else F.lit(None).cast(self._type(f))
                between.append(value.alias(f"__{name}{i}"))
        # One row per tile: a million rows make one of them.
        totals = tiled.groupBy(*[_quoted(c) for c in partition], TILE).agg(*parts)
        totals = totals.select(*[_quoted(c) for c in partition], TILE, *between)
        return null_safe_join(tiled.withColumns(inner), totals, [*partition, TILE]).drop(TILE)


_SIZE, TILE = "__partition_rows", "__tile"


def _at(column: str, offset: int) -> str:
    """The name of a column as fetched from another row."""
    return f"{column}_{offset}" if offset else column


def _bounds(start: int | None, end: int | None) -> tuple[int, int]:
    return W.unboundedPreceding if start is None else start, W.unboundedFollowing if end is None else end


def running(
    df: DataFrame,
    values: dict[str, tuple[str, Column]],
    partition: Sequence[str],
    order: Sequence[str | Order],
) -> DataFrame:
    """Add running ``sum`` / ``count`` / ``min`` / ``max`` columns: ``{name: (kind, value)}``."""
    return moving(df, values, partition, order, None, 0)


def moving(
    df: DataFrame,
    values: dict[str, tuple[str, Column]],
    partition: Sequence[str],
    order: Sequence[str | Order],
    start: int | None,
    end: int | None,
) -> DataFrame:
    """Add aggregates over the rows from ``start`` to ``end`` around the current one."""
    address = Addressing(df, partition, order)
    for n, (kind, value) in values.items():
        address.add(n, kind, value, start, end)
    return address.view()


def position(
    df: DataFrame, partition: Sequence[str], order: Sequence[str | Order], name: str = POSITION
) -> DataFrame:
    """Number the rows of each partition from 1, as ``row_number`` does."""
    return Addressing(df, partition, order).position(name).view()


def per_partition(df: DataFrame, values: dict[str, Column], partition: Sequence[str]) -> DataFrame:
    """Add aggregates over the whole partition to each row.

    Grouping and joining back combines map-side first, so a hot partition is never
    gathered; adaptive execution splits its rows in the join.
    """
    partition = list(partition)
    source = df if is_small(df) else settle(df)
    grouped = group(source, partition, *[value.alias(n) for n, value in values.items()])
    return attach(source, grouped, partition)


def neighbour(
    df: DataFrame,
    values: dict[str, Column],
    partition: Sequence[str],
    order: Sequence[str | Order],
    offset: int,
) -> DataFrame:
    """Add the values found ``offset`` rows further on (negative: further back)."""
    address = Addressing(df, partition, order)
    for n, value in values.items():
        address.neighbour(n, value, offset)
    return address.view()


def fold_affine(
    df: DataFrame,
    name: str,
    multiply: Column,
    add: Column,
    seed: float,
    partition: Sequence[str],
    order: Sequence[str | Order],
) -> DataFrame:
    """Add ``x[t] = multiply[t] * x[t-1] + add[t]`` with ``x[0] = seed`` per partition.

    Steps of this form compose, so each block is folded on its own and the blocks are then
    chained; no partition is ever held whole.
    """
    blocks = lay_out(df, partition, order)
    rows = blocks.rows if blocks.cut else blocks.rows.withColumn(BLOCK, F.lit(0))
    partition = [_quoted(c) for c in blocks.partition]
    scope = partition + [BLOCK]
    in_block = W.partitionBy(*scope).orderBy(*[k.sort() for k in blocks.order])
    steps = rows.withColumns(
        {
            POSITION: F.row_number().over(in_block),
            "__a": multiply.cast("double"),
            "__b": add.cast("double"),
        }
    )
    folded = steps.groupBy(*scope).applyInPandas(_fold_by(POSITION), schema=steps.schema)
    if blocks.cut:
        folded = settle(folded)
    # One row per block: its last step, then the blocks of a partition in order.
    ends = folded.groupBy(*scope).agg(
        F.max_by("__a", POSITION).alias("__a"),
        F.max_by("__b", POSITION).alias("__b"),
        F.lit(1).alias("__all"),
    )
    chained = ends.groupBy("__all", *partition).applyInPandas(_fold_by(BLOCK), schema=ends.schema)
    after_block = F.col("__a") * F.lit(float(seed)) + F.col("__b")
    entry = chained.select(
        *scope,
        F.lag(after_block, 1, float(seed))
        .over(W.partitionBy(*partition).orderBy(BLOCK))
        .alias("__in"),
    )
    joined = null_safe_join(folded, entry, blocks.partition + [BLOCK])
    entered = F.col("__a") * F.col("__in") + F.col("__b")
    value = F.when(F.col("__in") == 0, F.col("__b")).otherwise(entered)
    return joined.withColumn(name, F.nullif(value, F.lit(float("nan")))).drop(
        "__a", "__b", "__in", POSITION, BLOCK
    )


def _fold_by(column: str):
    def fold(pdf):
        pdf = pdf.sort_values(column, kind="stable")
        a, b, all_a, all_b = 1.0, 0.0, [], []
        for step_a, step_b in zip(pdf["__a"], pdf["__b"]):
            a, b = step_a * a, step_a * b + step_b
            all_a.append(a)
            all_b.append(b)
        return pdf.assign(__a=all_a, __b=all_b)

    return fold
