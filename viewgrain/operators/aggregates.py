"""Aggregates whose meaning or scale needs more than one built-in call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.functions.logic import safe_div
from viewgrain.plans.keys import attach, group, null_safe_join
from viewgrain.plans.ordered import Order, position, running
from viewgrain.plans.settle import block_rows, is_small, settle


def attr(col: str | Column) -> Column:
    """The value when all rows agree on it, else NULL."""
    return F.when(F.min(col) == F.max(col), F.min(col))


def record_count() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of two aggregates, NULL when the denominator is zero."""
    return safe_div(numerator, denominator)


def percentiles(
    df: DataFrame, dims: Sequence[str], wanted: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Exact interpolated percentiles ``{name: (column, p)}`` at the grain of ``dims``.

    A small input uses the built-in aggregate. Otherwise equal values are counted first,
    so what is ordered is distinct values; if there are still more than one task should
    hold, they are ranked by the block-wise running count and the two neighbouring values
    of each percentile are picked out.
    """
    dims = list(dims)
    if is_small(df):
        return _builtin_percentiles(df, dims, wanted, F.lit(1))
    out = group(df, dims, F.count(F.lit(1)).alias("__rows"))
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        mine = {n: p for n, (c, p) in wanted.items() if c == column}
        out = attach(out, _column_percentiles(df, dims, column, mine), dims)
    return out.drop("__rows")


def _builtin_percentiles(
    df: DataFrame, dims: list[str], wanted: Mapping[str, tuple[str, float]], frequency: Column
) -> DataFrame:
    """One aggregate per column, which gives all its percentiles at once."""
    names: dict[str, list[str]] = {}
    for name, (column, _) in wanted.items():
        names.setdefault(column, []).append(name)
    aggregates = [
        F.percentile(c, F.array(*[F.lit(float(wanted[n][1])) for n in mine]), frequency).alias(f"__of_{c}")
        for c, mine in names.items()
    ]
    places = {n: (c, i) for c, mine in names.items() for i, n in enumerate(mine)}
    return group(df, dims, *aggregates).select(
        *dims, *[F.get(f"__of_{places[n][0]}", F.lit(places[n][1])).alias(n) for n in wanted]
    )


def median(df: DataFrame, dims: Sequence[str], column: str, name: str) -> DataFrame:
    return percentiles(df, dims, {name: (column, 0.5)})


def value_counts(df: DataFrame, dims: Sequence[str], column: str) -> DataFrame:
    """How often each value occurs per group, written once for the steps that reread it."""
    value = F.col(column).cast("double").alias("__value")
    rows = df.where(F.col(column).isNotNull())
    return settle(rows.groupBy(*dims, value).agg(F.count(F.lit(1)).alias("__n")))


def _column_percentiles(
    df: DataFrame, dims: list[str], column: str, wanted: Mapping[str, float]
) -> DataFrame:
    counts = value_counts(df, dims, column)
    return percentiles_of_counts(counts, dims, wanted)


def percentiles_of_counts(
    counts: DataFrame, dims: list[str], wanted: Mapping[str, float]
) -> DataFrame:
    """Percentiles from (dims, __value, __n) rows."""
    if counts.count() <= block_rows(counts.sparkSession):
        of_value = {n: ("__value", p) for n, p in wanted.items()}
        return _builtin_percentiles(counts, dims, of_value, F.col("__n"))
    through = running(counts, {"__through": ("sum", F.col("__n"))}, dims, [Order("__value")])
    placed = attach(through, group(counts, dims, F.sum("__n").alias("__total")), dims)
    after = F.col("__through")
    before = after - F.col("__n")
    picks = []
    for name, p in wanted.items():
        at = F.lit(float(p)) * (F.col("__total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (before <= k) & (k < after)
        picks += [
            F.max(F.when(holds(low), F.col("__value"))).alias(f"__low_{name}"),
            F.max(F.when(holds(high), F.col("__value"))).alias(f"__high_{name}"),
            F.max(at - low).alias(f"__part_{name}"),
        ]
    picked = group(placed, dims, *picks)
    return picked.select(
        *dims,
        *[
            # Between equal values there is nothing to interpolate, and infinity less itself is no number.
            F.when(F.col(f"__low_{n}") == F.col(f"__high_{n}"), F.col(f"__low_{n}"))
            .otherwise(F.col(f"__low_{n}") + F.col(f"__part_{n}") * (F.col(f"__high_{n}") - F.col(f"__low_{n}")))
            .alias(n)
            for n in wanted
        ],
    )


def collect_values(
    df: DataFrame, dims: Sequence[str], column: str, distinct: bool = True, chunk: int = 10_000
) -> DataFrame:
    """The sorted values of each group as arrays of at most ``chunk`` values.

    Rows are (dims, chunk number from 0, values). A group of any size is spread over as
    many rows as it needs, so none is gathered whole.
    """
    dims = list(dims)
    rows = df.where(F.col(column).isNotNull()).select(*dims, column)
    if distinct:
        numbered = position(rows.distinct(), dims, [column])
        dealt = numbered.withColumn("chunk", F.floor((F.col("__position") - 1) / chunk))
        listed = dealt.groupBy(*dims, "chunk").agg(
            F.array_sort(F.collect_list(column)).alias(column)
        )
        return listed
    counted = running(
        rows.groupBy(*dims, column).agg(F.count(F.lit(1)).alias("__n")),
        {"__through": ("sum", F.col("__n"))},
        dims,
        [column],
    )
    # A value that occurs n times takes the places through-n .. through-1, cut at chunk ends.
    first, last = F.col("__through") - F.col("__n"), F.col("__through") - 1
    spread = counted.withColumn(
        "chunk", F.explode(F.sequence(F.floor(first / chunk), F.floor(last / chunk)))
    )
    start = F.greatest(first, F.col("chunk") * chunk)
    stop = F.least(last, F.col("chunk") * chunk + chunk - 1)
    pieces = spread.withColumn(
        "__piece", F.array_repeat(F.col(column), (stop - start + 1).cast("int"))
    )
    return pieces.groupBy(*dims, "chunk").agg(
        F.array_sort(F.flatten(F.collect_list("__piece"))).alias(column)
    )


def rollup_totals(
    df: DataFrame, hierarchy: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Subtotals along a hierarchy and the grand total.

    ``level`` is the number of hierarchy columns in force, which tells a subtotal from a
    group whose member is NULL.
    """
    grouping = [F.grouping(h) for h in hierarchy]
    level = F.lit(len(hierarchy))
    for g in grouping:
        level = level - g.cast("int")
    return df.rollup(*hierarchy).agg(
        level.alias("level"), *[m.alias(n) for n, m in measures.items()]
    )


def pivot_sets(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Cells, row totals, column totals and grand total of a pivot in one pass."""
    keys = [F.col(c) for c in [*rows, *cols]]
    sets = [
        keys,
        [F.col(c) for c in rows],
        [F.col(c) for c in cols],
        [],
    ]
    row_total = F.grouping(cols[0]).cast("int")
    col_total = F.grouping(rows[0]).cast("int")
    level = (
        F.when((row_total == 0) & (col_total == 0), "cell")
        .when((row_total == 1) & (col_total == 0), "row_total")
        .when((row_total == 0) & (col_total == 1), "column_total")
        .otherwise("grand_total")
    )
    return df.groupingSets(sets, *keys).agg(
        level.alias("level"), *[m.alias(n) for n, m in measures.items()]
    )


def distinct_counts(
    df: DataFrame, sets: Sequence[Sequence[str]], columns: Mapping[str, str], level: str = "set"
) -> DataFrame:
    """COUNTD at several grains: (dims, ``level``, counts), ``level`` the place in ``sets``.

    A cascade: the distinct pairs of the finest grain and a value are written once, those of
    each coarser grain come from the smallest written grain above it. So raw rows are read
    once per column and never multiplied by the number of grains. NULL values do not count;
    dims that a grain lacks are NULL.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    out: DataFrame | None = None
    for name, column in columns.items():
        pairs: dict[frozenset[str], DataFrame] = {}
        parts = []
        for place, keys in sorted(enumerate(sets), key=lambda s: -len(s[1])):
            want = frozenset(keys)
            if want not in pairs:
                above = min((g for g in pairs if g > want), key=len, default=None)
                source = pairs[above] if above is not None else df.select(*dims, F.col(f"`{column}`").alias("__value"))
                pairs[want] = settle(source.select(*[d for d in dims if d in want], "__value").distinct())
            counted = group(pairs[want], [d for d in dims if d in want], F.count("__value").alias(name))
            absent = {d: F.lit(None).cast(df.schema[d].dataType) for d in dims if d not in want}
            parts.append(counted.withColumns({**absent, level: F.lit(place)}).select(*dims, level, name))
        counts = reduce(DataFrame.unionByName, parts)
        out = counts if out is None else null_safe_join(out, counts, [*dims, level])
    return out


def rollup_distinct(
    df: DataFrame, hierarchy: Sequence[str], measures: Mapping[str, Column], distinct: Mapping[str, str]
) -> DataFrame:
    """``rollup_totals`` with COUNTD measures ``{name: column}`` beside the additive ones."""
    depth = len(hierarchy)
    sets = [list(hierarchy[: depth - i]) for i in range(depth + 1)]
    counts = distinct_counts(df, sets, distinct).withColumn("level", F.lit(depth) - F.col("set")).drop("set")
    return null_safe_join(rollup_totals(df, hierarchy, measures), counts, [*hierarchy, "level"])


def pivot_distinct(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Mapping[str, Column], distinct: Mapping[str, str]
) -> DataFrame:
    """``pivot_sets`` with COUNTD measures ``{name: column}`` beside the additive ones."""
    sets = [[*rows, *cols], list(rows), list(cols), []]
    counts = distinct_counts(df, sets, distinct)
    names = F.array(*[F.lit(n) for n in ("cell", "row_total", "column_total", "grand_total")])
    counts = counts.withColumn("level", F.element_at(names, F.col("set") + 1)).drop("set")
    return null_safe_join(pivot_sets(df, rows, cols, measures), counts, [*rows, *cols, "level"])
