"""Table calculations on a monthly view and on large member views."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.operators import tablecalc as tc
from viewgrain.operators.view import worksheet

PART, ORDER = ["r_name"], ["mn"]

_VIEW = """
    WITH v AS (SELECT r_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS mn,
                      round(sum(o_totalprice), 2) AS total, count(*) AS n
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
"""


def region_orders(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
    )


def monthly(spark, folder):
    month = F.date_trunc("month", "o_orderdate").cast("date")
    return worksheet(
        region_orders(spark, folder),
        ["r_name", ("mn", month)],
        {"total": F.round(F.sum("o_totalprice"), 2), "n": F.count(F.lit(1))},
    )


@query(_VIEW + """
    SELECT r_name, mn, total, n, round(sum(total) OVER w, 2) AS run_sum, round(avg(n) OVER w, 6) AS run_avg,
           count(total) OVER w AS run_count, min(total) OVER w AS run_min, max(total) OVER w AS run_max
    FROM v WINDOW w AS (PARTITION BY r_name ORDER BY mn ROWS UNBOUNDED PRECEDING)
""")
def running_calcs(spark, folder):
    calcs = tc.Calculations(monthly(spark, folder), PART, ORDER).running("avg", "n", "run_avg")
    for kind in ("sum", "count", "min", "max"):
        calcs.running(kind, "total", f"run_{kind}")
    return calcs.view().withColumns({"run_sum": F.round("run_sum", 2), "run_avg": F.round("run_avg", 6)})


@query(_VIEW + """
    SELECT r_name, mn, total, n,
      round(avg(n) OVER (PARTITION BY r_name ORDER BY mn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS avg_m2_0,
      round(sum(total) OVER (PARTITION BY r_name ORDER BY mn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 2) AS sum_m1_2,
      max(total) OVER (PARTITION BY r_name ORDER BY mn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS max_m3_m1,
      min(total) OVER (PARTITION BY r_name ORDER BY mn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS min_first_1,
      count(total) OVER (PARTITION BY r_name ORDER BY mn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS count_1_last,
      round(sum(total) OVER (PARTITION BY r_name), 2) AS sum_all
    FROM v
""")
def window_calcs(spark, folder):
    calcs = tc.Calculations(monthly(spark, folder), PART, ORDER)
    calcs.window("avg", "n", "avg_m2_0", -2, 0).window("sum", "total", "sum_m1_2", -1, 2)
    calcs.window("max", "total", "max_m3_m1", -3, -1).window("min", "total", "min_first_1", None, 1)
    calcs.window("count", "total", "count_1_last", 1, None).window("sum", "total", "sum_all")
    rounded = {c: F.round(c, 2) for c in ("sum_m1_2", "sum_all")}
    return calcs.view().withColumns({**rounded, "avg_m2_0": F.round("avg_m2_0", 6)})


@query(_VIEW + """
    SELECT r_name, mn, total, n, row_number() OVER w AS idx, 1 - row_number() OVER w AS first_offset,
           count(*) OVER (PARTITION BY r_name) - row_number() OVER w AS last_offset,
           count(*) OVER (PARTITION BY r_name) AS size
    FROM v WINDOW w AS (PARTITION BY r_name ORDER BY mn)
""")
def first_last_size(spark, folder):
    calcs = tc.Calculations(monthly(spark, folder), PART, ORDER)
    return calcs.index("idx").first("first_offset").last("last_offset").size("size").view()


@query("""
    WITH v AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
    SELECT o_custkey, n, total, rank() OVER (ORDER BY n DESC) AS rk, dense_rank() OVER (ORDER BY n DESC) AS dense,
           row_number() OVER (ORDER BY n DESC, total, o_custkey) AS uniq,
           rank() OVER (ORDER BY n DESC) + count(*) OVER (PARTITION BY n) - 1 AS modified,
           round(percent_rank() OVER (ORDER BY n DESC), 8) AS pct, rank() OVER (ORDER BY n) AS rk_asc
    FROM v
""")
def rank_kinds(spark, folder):
    view = worksheet(
        table(spark, folder, "orders"),
        ["o_custkey"],
        {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)},
    )
    view = tc.rank(view, "n", "uniq", "unique", tie_break=["total", "o_custkey"])
    kinds = {"rk": "rank", "dense": "dense", "modified": "modified", "pct": "percentile"}
    view = tc.ranks(view, "n", {name: (kind, False) for name, kind in kinds.items()} | {"rk_asc": ("rank", True)})
    return view.withColumn("pct", F.round("pct", 8))


@query(_VIEW + """
    SELECT r_name, mn, total, n, rank() OVER (PARTITION BY mn ORDER BY total DESC) AS rk FROM v
""")
def rank_in_month(spark, folder):
    return tc.rank(monthly(spark, folder), "total", "rk", partition=["mn"])


@query(_VIEW + """
    SELECT r_name, mn, total, n, lag(total, 1) OVER w AS before_1, lead(total, 3) OVER w AS after_3, total AS same,
           round(total - lag(total, 12) OVER w, 2) AS change_12
    FROM v WINDOW w AS (PARTITION BY r_name ORDER BY mn)
""")
def lookups(spark, folder):
    calcs = tc.Calculations(monthly(spark, folder), PART, ORDER)
    calcs.lookup("total", "before_1", -1).lookup("total", "after_3", 3).lookup("total", "same", 0)
    view = calcs.lookup("total", "before_12", -12).view()
    return view.withColumn("change_12", F.round(F.col("total") - F.col("before_12"), 2)).drop("before_12")


@query("""
    WITH v AS (SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 6) AS avg_price, count(DISTINCT o_custkey) AS customers
               FROM orders GROUP BY ALL),
         t AS (SELECT o_orderstatus AS s, round(avg(o_totalprice), 6) AS total_avg, count(DISTINCT o_custkey) AS total_customers FROM orders GROUP BY 1)
    SELECT o_orderstatus, o_orderpriority, avg_price, customers, total_avg, total_customers FROM v JOIN t ON o_orderstatus = s
""")
def total_from_rows(spark, folder):
    orders = table(spark, folder, "orders")
    view = worksheet(
        orders,
        ["o_orderstatus", "o_orderpriority"],
        {"avg_price": F.round(F.avg("o_totalprice"), 6), "customers": F.count_distinct("o_custkey")},
    )
    view = tc.total(view, orders, F.round(F.avg("o_totalprice"), 6), "total_avg", ["o_orderstatus"])
    return tc.total(view, orders, F.count_distinct("o_custkey"), "total_customers", ["o_orderstatus"])


@query(_VIEW + """
    SELECT r_name, mn, total, n, round(total / sum(total) OVER (PARTITION BY mn), 6) AS of_month,
           round(total / sum(total) OVER (), 8) AS of_all FROM v
""")
def percent_of_total(spark, folder):
    view = tc.percent_of_total(monthly(spark, folder), "total", "of_month", ["mn"])
    view = tc.percent_of_total(view, "total", "of_all", [])
    return view.withColumns({"of_month": F.round("of_month", 6), "of_all": F.round("of_all", 8)})


@query(_VIEW.replace("WITH v", "WITH RECURSIVE v") + """
    , o AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY mn) AS i FROM v),
    r AS (SELECT r_name, mn, i, CAST(100 + n AS DOUBLE) AS added, CAST(50 + n AS DOUBLE) AS smoothed FROM o WHERE i = 1
          UNION ALL
          SELECT o.r_name, o.mn, o.i, r.added + o.n, CAST(0.5 AS DOUBLE) * r.smoothed + o.n
          FROM o JOIN r ON o.r_name = r.r_name AND o.i = r.i + 1)
    SELECT r_name, mn, added, round(smoothed, 4) AS smoothed FROM r
""")
def previous_value(spark, folder):
    view = monthly(spark, folder).select("r_name", "mn", "n")
    view = tc.previous_value(view, "added", PART, ORDER, seed=100.0, add="n")
    view = tc.previous_value(view, "smoothed", PART, ORDER, seed=100.0, add="n", multiply=F.lit(0.5))
    return view.select("r_name", "mn", "added", F.round("smoothed", 4).alias("smoothed"))


@query(_VIEW + """
    SELECT r_name, mn, total, n, row_number() OVER (ORDER BY r_name, mn) AS i_table,
           row_number() OVER (PARTITION BY r_name ORDER BY mn) AS i_pane,
           row_number() OVER (PARTITION BY mn ORDER BY r_name) AS i_region FROM v
""")
def compute_using(spark, folder):
    view = monthly(spark, folder)
    for name, scope in {"i_table": "table", "i_pane": "pane", "i_region": "r_name"}.items():
        partition, order = tc.compute_using(["r_name", "mn"], scope)
        view = tc.index(view, name, partition, order)
    return view


@query("""
    WITH v AS (SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1)
    SELECT l_partkey, n, qty, round(sum(qty) OVER (ORDER BY qty DESC, n, l_partkey ROWS UNBOUNDED PRECEDING), 2) AS cum_qty,
           rank() OVER (ORDER BY n DESC) AS rk
    FROM v
""")
def pareto_parts(spark, folder):
    view = worksheet(
        table(spark, folder, "lineitem"),
        ["l_partkey"],
        {"n": F.count(F.lit(1)), "qty": F.round(F.sum("l_quantity"), 2)},
    )
    view = tc.running_value(view, "sum", "qty", "cum_qty", [], ["-qty", "n", "l_partkey"])
    return tc.rank(view.withColumn("cum_qty", F.round("cum_qty", 2)), "n", "rk")
