"""The rows behind each chart, and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.functions.dates import date_part
from viewgrain.operators import overlays, shapes
from viewgrain.operators.view import worksheet


def row_count():
    return F.count(F.lit(1))


def total():
    return F.round(F.sum("o_totalprice"), 2)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def chart_bar(spark, folder):
    return shapes.bar(table(spark, folder, "orders"), "o_orderpriority", {"n": row_count()}, color="o_orderstatus")


@query("""
    SELECT o_orderpriority, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share
    FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
""")
def chart_bar_100(spark, folder):
    view = shapes.bar_100(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", row_count(), "n")
    return view.withColumn("share", F.round("share", 6))


@query("""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "month", o_orderstatus, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY ALL
""")
def chart_line(spark, folder):
    view = shapes.line(table(spark, folder, "orders"), "o_orderdate", "month", {"total": total()}, color="o_orderstatus")
    return view.withColumn("month", F.col("month").cast("date"))


@query("""
    SELECT o_custkey, round(sum(o_totalprice), 2) AS x, count(*) AS y FROM orders GROUP BY 1
""")
def chart_scatter(spark, folder):
    return shapes.scatter(table(spark, folder, "orders"), {"x": total()}, {"y": row_count()}, ["o_custkey"])


@query("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def chart_scatter_raw(spark, folder):
    rows = table(spark, folder, "lineitem")
    return shapes.scatter(rows, {"x": F.col("l_quantity")}, {"y": F.col("l_extendedprice")})


@query("""
    SELECT c_mktsegment, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)
""")
def chart_pie(spark, folder):
    view = shapes.pie(table(spark, folder, "customer"), "c_mktsegment", row_count(), "n")
    return view.withColumn("share", F.round("share", 6))


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS price FROM part GROUP BY ALL")
def chart_heatmap(spark, folder):
    return shapes.heatmap(
        table(spark, folder, "part"), "p_brand", "p_type", F.round(F.avg("p_retailprice"), 6), "price"
    )


@query("""
    SELECT floor(c_acctbal / 250.0) * 250.0 AS bin, count(*) AS n FROM customer GROUP BY 1
""")
def chart_histogram_size(spark, folder):
    return shapes.histogram(table(spark, folder, "customer"), "c_acctbal", size=250.0)


@query("""
    WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT bin, round(lo + bin * (hi - lo) / 20, 4) AS bin_start, round(lo + (bin + 1) * (hi - lo) / 20, 4) AS bin_end, count(*) AS n
    FROM (SELECT CAST(least(floor((l_extendedprice - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, lo, hi FROM lineitem, e)
    GROUP BY bin, lo, hi
""")
def chart_histogram_bins(spark, folder):
    out = shapes.histogram(table(spark, folder, "lineitem"), "l_extendedprice", bins=20)
    return out.withColumns({"bin_start": F.round("bin_start", 4), "bin_end": F.round("bin_end", 4)})


@query("""
    WITH q AS (SELECT event_type AS t, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
               FROM events GROUP BY 1)
    SELECT event_type, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
      min(value) AS "min", max(value) AS "max", min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
      max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
      count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM events JOIN q ON event_type = t GROUP BY 1
""")
def chart_boxplot(spark, folder):
    out = shapes.boxplot(table(spark, folder, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
def chart_counter(spark, folder):
    return shapes.counter(table(spark, folder, "orders"), total(), "total", [F.col("o_orderstatus") == "F"])


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number
    FROM orders WHERE o_orderstatus <> 'P'
""")
def chart_table(spark, folder):
    return shapes.table(
        table(spark, folder, "orders"),
        ["o_orderkey", "o_custkey", "o_totalprice"],
        ["-o_totalprice", "o_orderkey"],
        [F.col("o_orderstatus") != "P"],
    )


@query("""
    SELECT p_brand, p_type, CASE WHEN grouping(p_brand) = 0 AND grouping(p_type) = 0 THEN 'cell' WHEN grouping(p_brand) = 0 THEN 'row_total'
      WHEN grouping(p_type) = 0 THEN 'column_total' ELSE 'grand_total' END AS level, count(*) AS n
    FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), (p_type), ())
""")
def chart_pivot(spark, folder):
    return shapes.pivot(table(spark, folder, "part"), ["p_brand"], ["p_type"], {"n": row_count()})


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers
    FROM orders GROUP BY 1
""")
def chart_combo(spark, folder):
    return shapes.combo(
        table(spark, folder, "orders"),
        ("yr", date_part("year", F.col("o_orderdate"))),
        {"total": total()},
        {"customers": F.count_distinct("o_custkey")},
    )


@query("""
    WITH w AS (SELECT n_name, CAST(count(*) AS DOUBLE) AS c, round(sum(c_acctbal), 2) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    t AS (SELECT n_name FROM w ORDER BY c + b DESC, n_name LIMIT 15)
    SELECT n_name, 'Customers' AS "Metric", c AS "Value" FROM w WHERE n_name IN (SELECT n_name FROM t)
    UNION ALL SELECT n_name, 'Total Balance', b FROM w WHERE n_name IN (SELECT n_name FROM t)
""")
def chart_geo_bar(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return shapes.geo_bar(rows, "n_name", {"Customers": row_count(), "Total_Balance": F.round(F.sum("c_acctbal"), 2)})


@query("""
    SELECT yr, total, round(sum(total) OVER (ORDER BY yr), 2) AS "end", round(sum(total) OVER (ORDER BY yr) - total, 2) AS "start"
    FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
""")
def chart_waterfall(spark, folder):
    rows = table(spark, folder, "orders").withColumn("yr", date_part("year", F.col("o_orderdate")))
    out = shapes.waterfall(rows, "yr", total(), "total")
    return out.withColumns({"start": F.round("start", 2), "end": F.round("end", 2)})


@query("""
    SELECT event_type, n, round(n / max(n) OVER (), 6) AS of_first, round(n / lag(n) OVER (ORDER BY n DESC, event_type), 6) AS of_previous
    FROM (SELECT event_type, count(DISTINCT user_id) * 1000 + count(*) AS n FROM events GROUP BY 1)
""")
def chart_funnel(spark, folder):
    size = F.count_distinct("user_id") * 1000 + row_count()
    out = shapes.funnel(table(spark, folder, "events"), "event_type", size, "n")
    return out.withColumns({c: F.round(c, 6) for c in ("of_first", "of_previous")})


@query("""
    SELECT p_type, p_brand, CAST(2 - grouping(p_type) - grouping(p_brand) AS INTEGER) AS level, round(sum(p_retailprice), 2) AS price
    FROM part GROUP BY ROLLUP (p_type, p_brand)
""")
def chart_treemap(spark, folder):
    return shapes.treemap(
        table(spark, folder, "part"), ["p_type", "p_brand"], {"price": F.round(F.sum("p_retailprice"), 2)}
    )


@query("""
    SELECT l_orderkey, min(l_shipdate) AS "start", max(l_shipdate) AS "end", date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) AS days
    FROM lineitem GROUP BY 1
""")
def chart_gantt(spark, folder):
    return shapes.gantt(table(spark, folder, "lineitem"), "l_orderkey", "l_shipdate", "l_shipdate")


@query("""
    SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS actual, round(sum(o_totalprice), 2) AS target,
      round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / sum(o_totalprice), 6) AS attainment
    FROM orders GROUP BY 1
""")
def chart_bullet(spark, folder):
    done = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    out = shapes.bullet(table(spark, folder, "orders"), "o_orderpriority", F.round(done, 2), total())
    return out.withColumn("attainment", F.round("attainment", 6))


@query("""
    SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS "AUTOMOBILE", count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "BUILDING",
      count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS "FURNITURE", count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS "HOUSEHOLD",
      count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "MACHINERY"
    FROM customer GROUP BY 1
""")
def chart_crosstab_text(spark, folder):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cells = shapes.crosstab_text(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment", row_count(), segments)
    return cells.na.fill(0, segments)


def yearly(spark, folder):
    return worksheet(
        table(spark, folder, "orders"),
        ["o_orderpriority", ("yr", date_part("year", F.col("o_orderdate")))],
        {"total": total()},
    )


_YEARLY = """
    WITH v AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
"""


@query(_YEARLY + """
    SELECT o_orderpriority, yr, total, CAST(1000000 AS DOUBLE) AS goal, round(avg(total) OVER (), 5) AS table_avg,
      median(total) OVER (PARTITION BY o_orderpriority) AS pane_median, max(total) OVER (PARTITION BY o_orderpriority) AS pane_max
    FROM v
""")
def reference_lines(spark, folder):
    dims = ["o_orderpriority", "yr"]
    view = overlays.reference_line(yearly(spark, folder), dims, "total", 1_000_000, name="goal")
    view = overlays.reference_line(view, dims, "total", "avg", "table", "table_avg")
    view = overlays.reference_line(view, dims, "total", "median", "pane", "pane_median")
    view = overlays.reference_line(view, dims, "total", "max", "pane", "pane_max")
    return view.withColumn("table_avg", F.round("table_avg", 5))


@query(_YEARLY + """
    SELECT o_orderpriority, yr, total, round(lo, 3) AS band_low, round(hi, 3) AS band_high FROM v JOIN
      (SELECT o_orderpriority AS p, quantile_cont(total, 0.1) AS lo, quantile_cont(total, 0.9) AS hi FROM v GROUP BY 1) ON p = o_orderpriority
""")
def distribution_bands(spark, folder):
    out = overlays.distribution_band(yearly(spark, folder), ["o_orderpriority", "yr"], "total", 0.1, 0.9, "pane")
    return out.withColumns({c: F.round(c, 3) for c in ("band_low", "band_high")})


@query(_YEARLY + """
    SELECT o_orderpriority, yr, total, round(b, 2) AS slope, round(a, 0) AS intercept, round(r, 6) AS r2, round(a + b * yr, 1) AS fitted FROM v JOIN
      (SELECT o_orderpriority AS p, regr_slope(total, yr) AS b, regr_intercept(total, yr) AS a, regr_r2(total, yr) AS r FROM v GROUP BY 1)
      ON p = o_orderpriority
""")
def trend_lines(spark, folder):
    out = overlays.trend_line(yearly(spark, folder), "yr", "total", ["o_orderpriority"])
    digits = {"slope": 2, "intercept": 0, "r2": 6, "fitted": 1}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
