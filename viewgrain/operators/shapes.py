"""The rows behind each chart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.functions.dates import date_diff, date_trunc
from viewgrain.functions.logic import safe_div
from viewgrain.functions.numbers import bin_numeric
from viewgrain.operators import aggregates, reshape, tablecalc
from viewgrain.operators.filters import filter_rows
from viewgrain.operators.view import Dims, named, worksheet
from viewgrain.plans.keys import attach, attach_constants, group
from viewgrain.plans.ordered import Order, position


def bar(df: DataFrame, dim, measures: Mapping[str, Column], color=None) -> DataFrame:
    return worksheet(df, [dim, *([color] if color is not None else [])], measures)


def bar_100(df: DataFrame, dim, color, measure: Column, name: str) -> DataFrame:
    """Each colour's share within its bar (also the 100 % area)."""
    view = worksheet(df, [dim, color], {name: measure})
    return tablecalc.percent_of_total(view, name, "share", [named([dim])[0][0]])


def line(
    df: DataFrame, date: str, part: str, measures: Mapping[str, Column], color=None
) -> DataFrame:
    """A time series at one date grain, one line per colour (also the area chart)."""
    dims = [(part, date_trunc(part, F.col(date))), *([color] if color is not None else [])]
    return worksheet(df, dims, measures)


def scatter(
    df: DataFrame, x: Mapping[str, Column], y: Mapping[str, Column], detail: Dims = ()
) -> DataFrame:
    """Two measures at the detail grain; raw pairs when there is no detail."""
    pair = {**x, **y}
    if not detail:
        return df.select(*[c.alias(n) for n, c in pair.items()])
    return worksheet(df, detail, pair)


def pie(df: DataFrame, category, measure: Column, name: str) -> DataFrame:
    view = worksheet(df, [category], {name: measure})
    return tablecalc.percent_of_total(view, name, "share", [])


def heatmap(df: DataFrame, x, y, measure: Column, name: str) -> DataFrame:
    return worksheet(df, [x, y], {name: measure})


def histogram(
    df: DataFrame, x: str, size: float | None = None, bins: int | None = None
) -> DataFrame:
    """Counts per bin: of width ``size`` from zero, or ``bins`` equal ones from min to max."""
    values = df.where(F.col(x).isNotNull()).select(x)
    if size is not None:
        return worksheet(values, [("bin", bin_numeric(x, size))], {"n": F.count(F.lit(1))})
    if bins is None:
        raise ValueError("a histogram needs a bin size or a number of bins")
    ends = values.agg(F.min(x).alias("__min"), F.max(x).alias("__max"))
    low, high = F.col("__min").cast("double"), F.col("__max").cast("double")
    slot = F.coalesce(F.floor(safe_div((F.col(x) - low) * bins, high - low)), F.lit(0))
    placed = attach_constants(values, ends).select(
        F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"), low.alias("lo"), high.alias("hi")
    )
    counted = placed.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
    )


def boxplot(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Five numbers, 1.5 IQR whiskers and the number of outliers per group.

    Works on counted distinct values, so the rows are read once and then shrink.
    """
    by = list(by)
    counts = aggregates.value_counts(df, by, x)
    quartiles = aggregates.percentiles_of_counts(counts, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v = F.col("__value")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    spread = group(
        attach(counts, quartiles, by),
        by,
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("__n"))).alias("outliers"),
    )
    return attach(quartiles, spread, by)


def counter(df: DataFrame, measure: Column, name: str, filters: Iterable[Column] = ()) -> DataFrame:
    return worksheet(df, [], {name: measure}, filters)


def table(
    df: DataFrame,
    columns: Sequence[str],
    sort: Sequence[str | Order],
    filters: Iterable[Column] = (),
    row_number: str = "row_number",
) -> DataFrame:
    """Table rows with their place under ``sort``."""
    return position(filter_rows(df, filters).select(*columns), [], sort, row_number)


def pivot(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    return aggregates.pivot_sets(df, rows, cols, measures)


def combo(df: DataFrame, x, first: Mapping[str, Column], second: Mapping[str, Column]) -> DataFrame:
    return worksheet(df, [x], {**first, **second})


def geo_bar(df: DataFrame, geo: str, measures: Mapping[str, Column], top_n: int = 15) -> DataFrame:
    """The bar chart that stands in for a map: measures unpivoted for the top members."""
    return reshape.unpivot_top(df, [geo], measures, top_n)


def waterfall(df: DataFrame, dim: str, measure: Column, name: str) -> DataFrame:
    """Each step with the level it starts and ends at."""
    view = worksheet(df, [dim], {name: measure})
    ended = tablecalc.running_value(view, "sum", name, "end", [], [dim])
    return ended.withColumn("start", F.col("end") - F.col(name))


def funnel(df: DataFrame, stage: str, measure: Column, name: str) -> DataFrame:
    """Stages from largest to smallest with the share of the first and of the one before."""
    view = worksheet(df, [stage], {name: measure})
    before = tablecalc.lookup(view, name, "__before", -1, [], [Order(name, True), stage])
    first = tablecalc.window_value(before, "max", name, "__first", [], [])
    return first.withColumns(
        {
            "of_first": safe_div(F.col(name), F.col("__first")),
            "of_previous": safe_div(F.col(name), F.col("__before")),
        }
    ).drop("__before", "__first")


def treemap(df: DataFrame, levels: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return aggregates.rollup_totals(df, levels, measures)


def gantt(df: DataFrame, task, start: str, end: str) -> DataFrame:
    view = worksheet(df, [task], {"start": F.min(start), "end": F.max(end)})
    return view.withColumn("days", date_diff("day", F.col("start"), F.col("end")))


def bullet(df: DataFrame, dim, actual: Column, target: Column) -> DataFrame:
    """Actual, target and attainment (also the gauge)."""
    view = worksheet(df, [dim], {"actual": actual, "target": target})
    return view.withColumn("attainment", safe_div(F.col("actual"), F.col("target")))


def crosstab_text(df: DataFrame, rows: Sequence[str], col: str, measure: Column, values) -> DataFrame:
    return reshape.crosstab(df, rows, col, measure, values)
