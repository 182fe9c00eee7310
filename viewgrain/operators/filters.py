"""Filter predicates and member filters with business-intelligence semantics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.plans.keys import attach_constants
from viewgrain.plans.settle import settle

# The spellings of the NULL member in a member list.
NULL_MEMBERS = ("%null%", "null")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split_members(values: Iterable) -> tuple[list, bool]:
    values = list(values)
    kept = [
        v
        for v in values
        if v is not None and not (isinstance(v, str) and v.lower() in NULL_MEMBERS)
    ]
    return kept, len(kept) < len(values)


def isin_members(col: str | Column, values: Iterable) -> Column:
    """Keep the listed members; a NULL member in the list keeps NULL rows too."""
    c = _column(col)
    members, with_null = _split_members(values)
    if not members:
        return c.isNull() if with_null else F.lit(False)
    return c.isin(members) | c.isNull() if with_null else c.isin(members)


def notin_members(col: str | Column, values: Iterable, keep_null: bool = False) -> Column:
    """Drop the listed members. NULL rows go as in SQL, unless ``keep_null`` asks otherwise."""
    c = _column(col)
    members, with_null = _split_members(values)
    if not members:
        return c.isNotNull() if with_null else F.lit(True)
    rest = ~c.isin(members)
    if with_null:
        return rest & c.isNotNull()
    return rest | c.isNull() if keep_null else rest


def exclude_tuples(conjuncts: Mapping[str, Iterable], keep_null: bool = False) -> Column:
    """Drop only the rows in which every column has one of its listed members."""
    return exclude_tuple_union([conjuncts], keep_null)


def exclude_tuple_union(
    groups: Sequence[Mapping[str, Iterable]], keep_null: bool = False
) -> Column:
    """Drop the rows that any of the tuple groups covers."""
    if len(groups) == 1 and len(groups[0]) == 1:
        ((column, values),) = groups[0].items()
        return notin_members(column, values, keep_null)
    covered = reduce(
        Column.__or__,
        [
            reduce(Column.__and__, [isin_members(c, values) for c, values in g.items()])
            for g in groups
        ],
    )
    return ~F.coalesce(covered, F.lit(False)) if keep_null else ~covered


def in_range(col: str | Column, lo=None, hi=None) -> Column:
    """Inclusive range with either bound optional."""
    c = _column(col)
    bounds = ([c >= F.lit(lo)] if lo is not None else []) + ([c <= F.lit(hi)] if hi is not None else [])
    return reduce(Column.__and__, bounds) if bounds else F.lit(True)


# Months or days covered by one unit of a relative date.
_UNIT_MONTHS = {"year": 12, "quarter": 3, "month": 1}
_UNIT_DAYS = {"week": 7, "day": 1}


def relative_date(col: str | Column, unit: str, n: int, anchor: dt.date) -> Column:
    """Keep the last ``n`` units (or the next ``-n``), the anchor's own unit included.

    The bounds are computed from the anchor here, so the predicate is a plain range that
    reaches the scan.
    """
    start = _truncate(anchor, unit)
    if n > 0:
        lo, hi = _shift(start, unit, 1 - n), _shift(start, unit, 1)
    else:
        lo, hi = start, _shift(start, unit, -n)
    return date_range(col, lo, hi)


def _truncate(day: dt.date, unit: str) -> dt.date:
    day = dt.date(day.year, day.month, day.day)
    if unit in _UNIT_DAYS:
        return day - dt.timedelta(days=day.weekday()) if unit == "week" else day
    months = _UNIT_MONTHS[unit]
    return dt.date(day.year, (day.month - 1) // months * months + 1, 1)


def _shift(day: dt.date, unit: str, n: int) -> dt.date:
    if unit in _UNIT_DAYS:
        return day + dt.timedelta(days=n * _UNIT_DAYS[unit])
    months = day.year * 12 + day.month - 1 + n * _UNIT_MONTHS[unit]
    return dt.date(months // 12, months % 12 + 1, 1)


def date_range(col: str | Column, start: dt.date, end: dt.date) -> Column:
    """Half-open range ``start <= col < end``.

    Date literals widen to the column's own type, so the column stays free of casts and
    the range reaches the scan.
    """
    c = _column(col)
    return (c >= F.lit(start)) & (c < F.lit(end))


def in_year(col: str | Column, year: int) -> Column:
    """``year(col) = year`` as a range, which row-group statistics and partitions can prune."""
    return date_range(col, dt.date(year, 1, 1), dt.date(year + 1, 1, 1))


def wildcard(col: str | Column, mode: str, text: str) -> Column:
    """Literal text match: ``contains``, ``starts``, ``ends`` or ``exact``."""
    c = _column(col)
    match mode:
        case "contains":
            return c.contains(text)
        case "starts":
            return c.startswith(text)
        case "ends":
            return c.endswith(text)
        case "exact":
            return c == text
    raise ValueError(f"unknown wildcard mode {mode!r}")


def filter_rows(df: DataFrame, predicates: Iterable[Column]) -> DataFrame:
    """Apply row predicates one after another (extract, data-source, context, dimension)."""
    return reduce(DataFrame.where, predicates, df)


def condition_members(df: DataFrame, dim: str, aggregate: Column, keep) -> DataFrame:
    """Keep the rows of members whose aggregate passes ``keep(Column)``."""
    members = df.groupBy(dim).agg(aggregate.alias("__value")).where(keep(F.col("__value")))
    return keep_members(df, dim, members.select(dim))


def keep_members(df: DataFrame, dim: str, members: DataFrame, invert: bool = False) -> DataFrame:
    """Semi or anti join on one column with NULL as an ordinary member."""
    marked = members.select(F.col(members.columns[0]).alias("__member"))
    on = df[dim].eqNullSafe(marked["__member"])
    return df.join(marked, on, "left_anti" if invert else "left_semi")


def top_members(
    df: DataFrame, dim: str, by: Column, n: int, ascending: bool = False, ties: str = "rank"
) -> DataFrame:
    """Keep all rows of the ``n`` members with the largest (smallest) aggregate ``by``.

    ``ties="rank"`` keeps every member level with the n-th one, ``ties="strict"`` keeps
    exactly n, the smallest member first among equals.
    """
    return keep_members(df, dim, rank_members(df, dim, by, n, ascending, ties).select(dim))


def rank_members(
    df: DataFrame, dim: str, by: Column, n: int, ascending: bool = False, ties: str = "rank"
) -> DataFrame:
    """The top members and their value. ``orderBy.limit`` keeps n rows per task; no ranking
    window runs over all members."""
    totals = df.groupBy(dim).agg(by.alias("__by"))
    key = F.col("__by").asc_nulls_last() if ascending else F.col("__by").desc_nulls_last()
    if ties == "strict":
        return totals.orderBy(key, F.col(dim).asc_nulls_first()).limit(n)
    if ties != "rank":
        raise ValueError(f"unknown tie rule {ties!r}")
    # The totals are compared with the n-th of themselves, so both must be the same numbers.
    totals = settle(totals)
    last = totals.orderBy(key).limit(n).agg(
        (F.max("__by") if ascending else F.min("__by")).alias("__last"),
        F.count_if(F.col("__by").isNull()).alias("__nulls"),
    )
    by_value, bound = F.col("__by"), F.col("__last")
    reached = by_value <= bound if ascending else by_value >= bound
    # NULL totals sort last and tie with one another.
    kept = (F.col("__nulls") > 0) | F.coalesce(reached, F.lit(False))
    return attach_constants(totals, last).where(kept).drop("__last", "__nulls")


def set_filter(df: DataFrame, col: str, members: DataFrame, invert: bool = False) -> DataFrame:
    """IN / NOT IN a member set of any size."""
    return keep_members(df, col, members, invert)


def page_filter(df: DataFrame, col: str, value) -> DataFrame:
    """One page of a paged view."""
    return df.where(F.col(col).eqNullSafe(F.lit(value)))


def filter_domain(df: DataFrame, col: str) -> DataFrame:
    """The values a filter control offers."""
    return df.select(col).distinct()


def filter_associativity(df: DataFrame, col: str, other: Sequence[Column]) -> DataFrame:
    """Per value of ``col``: all rows, and the rows that pass all the *other* filters."""
    passes = reduce(Column.__and__, other) if other else F.lit(True)
    return df.groupBy(col).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.coalesce(passes, F.lit(False))).alias("associated_rows"),
    )


def associativity(df: DataFrame, controls: Mapping[str, Column | None]) -> DataFrame:
    """(control, value, total_rows, associated_rows) for the values of every filter control.

    ``controls`` gives the column of each control and its predicate, None where nothing is
    chosen. A row counts as associated with its value of a control if it passes all *other*
    filters. One scan: each row notes the filters it fails in a bit mask and is counted once
    per control, map-side, so only counts are shuffled. A predicate that is NULL fails;
    values are given as text.
    """
    names = list(controls)
    if len(names) > 63:
        raise ValueError("at most 63 controls fit a bit mask")
    chosen = {i: controls[c] for i, c in enumerate(names) if controls[c] is not None}
    failed = F.lit(0).cast("long")
    for i, passes in chosen.items():
        failed = failed + F.when(F.coalesce(passes, F.lit(False)), 0).otherwise(1 << i).cast("long")
    marked = df.select(*[F.col(f"`{c}`").cast("string").alias(f"__c{i}") for i, c in enumerate(names)], failed.alias("__failed"))
    seen = [
        F.struct(
            F.lit(c).alias("control"),
            F.col(f"__c{i}").alias("value"),
            (F.col("__failed").bitwiseAND(F.lit(~(1 << i)).cast("long")) == 0).alias("passes"),
        )
        for i, c in enumerate(names)
    ]
    rows = marked.select(F.explode(F.array(*seen)).alias("s")).select("s.*")
    return rows.groupBy("control", "value").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("passes").alias("associated_rows")
    )


def cross_filter(frames: Mapping[str, DataFrame], selection: Mapping[str, Iterable]) -> dict[str, DataFrame]:
    """Apply one selection to every dataset that carries the selected fields."""
    return {
        name: filter_rows(
            df, [isin_members(c, values) for c, values in selection.items() if c in df.columns]
        )
        for name, df in frames.items()
    }


def entitlement_filter(
    df: DataFrame,
    key: str,
    grants: DataFrame,
    user: str | None = None,
    groups: Iterable[str] = (),
) -> DataFrame:
    """Row-level security: keep rows whose ``key`` is granted to the user or a group.

    ``grants`` has the columns (principal, key).
    """
    who = F.current_user() if user is None else F.lit(user)
    principal = F.col("principal")
    allowed = (principal == who) | isin_members(principal, groups)
    return keep_members(df, key, grants.where(allowed).select(key).distinct())


def user_domain(user: str | Column) -> Column:
    return F.split_part(F.lit(user) if isinstance(user, str) else user, F.lit("@"), F.lit(2))

