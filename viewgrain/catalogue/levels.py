"""Level-of-detail values."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.functions.dates import date_part
from viewgrain.operators import lod
from viewgrain.operators.view import worksheet


def year():
    return ("yr", date_part("year", F.col("o_orderdate")))


def month():
    return ("mn", date_part("month", F.col("o_orderdate")))


def customers(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])


def orders_by_nation(spark, folder):
    orders = table(spark, folder, "orders")
    rows = customers(spark, folder)
    return orders.join(rows, orders["o_custkey"] == rows["c_custkey"])


@query("""
    SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total
    FROM orders
""")
def fixed_customer_total(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = lod.fixed(orders, ["o_custkey"], {"customer_total": F.round(F.sum("o_totalprice"), 2)})
    return rows.select("o_orderkey", "o_custkey", "customer_total")


@query("""
    SELECT o_orderstatus, round(sum(o_totalprice) / any_value(t), 6) AS share
    FROM orders, (SELECT sum(o_totalprice) AS t FROM orders) GROUP BY 1
""")
def fixed_global(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_totalprice")
    rows = lod.fixed(orders, [], {"table_total": F.sum("o_totalprice")})
    share = F.try_divide(F.sum("o_totalprice"), F.max("table_total"))
    return worksheet(rows, ["o_orderstatus"], {"share": F.round(share, 6)})


@query("""
    WITH f AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS best
               FROM orders GROUP BY ALL)
    SELECT o_orderkey, customers, round(o_totalprice / best, 6) AS of_best
    FROM orders JOIN f ON o_orderstatus = s AND o_orderpriority = p
""")
def fixed_distinct(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    rows = lod.fixed(
        orders,
        ["o_orderstatus", "o_orderpriority"],
        {"customers": F.count_distinct("o_custkey"), "best": F.max("o_totalprice")},
    )
    return rows.select(
        "o_orderkey", "customers", F.round(F.try_divide("o_totalprice", "best"), 6).alias("of_best")
    )


@query("""
    SELECT n_name, round(avg(v), 6) AS avg_customer_sales FROM (
      SELECT n_name, o_custkey, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1
""")
def include_avg_per_nation(spark, folder):
    view = lod.include(
        orders_by_nation(spark, folder), ["n_name"], ["o_custkey"],
        F.sum("o_totalprice"), F.avg, "avg_customer_sales",
    )
    return view.withColumn("avg_customer_sales", F.round("avg_customer_sales", 6))


@query("""
    WITH v AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mn,
                      round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL),
         e AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(o_totalprice), 2) AS year_total FROM orders GROUP BY ALL)
    SELECT v.yr, v.mn, v.total, e.year_total FROM v JOIN e ON v.yr = e.yr
""")
def exclude_month(spark, folder):
    return lod.exclude(
        table(spark, folder, "orders"), [year(), month()], ["mn"],
        F.round(F.sum("o_totalprice"), 2), "year_total",
        {"total": F.round(F.sum("o_totalprice"), 2)},
    )


@query("""
    WITH f AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1),
         m AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders)
    SELECT o_orderstatus, round(avg(t), 5) AS avg_total FROM m JOIN f USING (o_custkey) GROUP BY 1
""")
def fixed_in_view(spark, folder):
    view = lod.fixed_in_view(
        table(spark, folder, "orders"), ["o_orderstatus"], ["o_custkey"],
        F.sum("o_totalprice"), F.avg, "avg_total",
    )
    return view.withColumn("avg_total", F.round("avg_total", 5))


@query("""
    SELECT c_mktsegment, round(avg(t), 5) AS avg_customer_total, max(n) AS most_orders FROM (
      SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS t, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1
""")
def nested_avg_customer(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return lod.nested(
        rows,
        [
            (["c_mktsegment", "o_custkey"], {"t": F.sum("o_totalprice"), "n": F.count(F.lit(1))}),
            (["c_mktsegment"], {"avg_customer_total": F.round(F.avg("t"), 5), "most_orders": F.max("n")}),
        ],
    )


@query("""
    WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS first_date FROM orders GROUP BY 1)
    SELECT CAST(year(first_date) AS INTEGER) AS cohort, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n,
           count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN c ON o_custkey = k GROUP BY ALL
""")
def cohort_first_year(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    rows = lod.cohort(orders, "o_custkey", "o_orderdate", "first_date")
    return worksheet(
        rows,
        [("cohort", date_part("year", F.col("first_date"))), year()],
        {
            "n": F.count(F.lit(1)),
            "customers": F.count_distinct("o_custkey"),
            "total": F.round(F.sum("o_totalprice"), 2),
        },
    )


@query("""
    WITH j AS (SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS yr, o_custkey, o_totalprice
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
         v AS (SELECT r_name, yr, sum(o_totalprice) AS sales, count(o_custkey) AS n FROM j GROUP BY ALL),
         r AS (SELECT r_name AS r, avg(o_totalprice) AS region_avg FROM j GROUP BY 1), y AS (SELECT yr AS y, max(o_totalprice) AS year_max FROM j GROUP BY 1),
         n AS (SELECT r_name AS nr, yr AS ny, max(s) AS best_nation FROM (SELECT r_name, yr, n_name, t.s FROM (SELECT DISTINCT r_name, yr, n_name FROM j) JOIN
               (SELECT n_name AS nn, yr AS nyr, sum(o_totalprice) AS s FROM j GROUP BY ALL) t ON n_name = nn AND yr = nyr) GROUP BY ALL),
         c AS (SELECT r_name AS cr, yr AS cy, avg(s) AS customer_avg FROM (SELECT DISTINCT r_name, yr, o_custkey FROM j) JOIN
               (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM j GROUP BY 1) ON o_custkey = k GROUP BY ALL)
    SELECT r_name, yr, round(sales, 2) AS sales, n, round(region_avg, 4) AS region_avg, year_max, (SELECT min(o_totalprice) FROM j) AS least,
           round(best_nation, 2) AS best_nation, round(customer_avg, 2) AS customer_avg
    FROM v JOIN r ON r_name = r JOIN y ON yr = y JOIN n ON r_name = nr AND yr = ny JOIN c ON r_name = cr AND yr = cy
""")
def many_levels(spark, folder):
    """Seven values at six grains over one scan of the rows."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    rows = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("yr", F.year("o_orderdate"))
    )
    price = "o_totalprice"
    view = lod.levels(
        rows,
        ["r_name", "yr"],
        {
            "sales": lod.Level(("r_name", "yr"), "sum", price),
            "n": lod.Level(("r_name", "yr"), "count", "o_custkey"),
            "region_avg": lod.Level(("r_name",), "avg", price),
            "year_max": lod.Level(("yr",), "max", price),
            "least": lod.Level((), "min", price),
            "best_nation": lod.Level(("n_name", "yr"), "sum", price, outer="max"),
            "customer_avg": lod.Level(("o_custkey",), "sum", price, outer="avg"),
        },
    )
    two = {c: F.round(c, 2) for c in ("sales", "best_nation", "customer_avg")}
    return view.withColumns({**two, "region_avg": F.round("region_avg", 4)})
