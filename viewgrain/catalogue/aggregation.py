"""Aggregates, totals and metric views."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.functions.dates import date_part
from viewgrain.operators import aggregates as agg
from viewgrain.operators import sketches
from viewgrain.operators.metricview import Dimension, Lookup, MetricView
from viewgrain.operators.view import worksheet
from viewgrain.plans.keys import attach
from viewgrain.plans.settle import settle


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
           min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(l_partkey) AS n, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY ALL
""")
def basic_aggregates(spark, folder):
    return worksheet(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "sum_qty": F.round(F.sum("l_quantity"), 2),
            "avg_price": F.round(F.avg("l_extendedprice"), 6),
            "min_disc": F.min("l_discount"),
            "max_tax": F.max("l_tax"),
            "n": F.count("l_partkey"),
            "suppliers": F.count_distinct("l_suppkey"),
        },
    )


@query()
def approximate_aggregates(spark, folder):
    return worksheet(
        table(spark, folder, "lineitem"),
        ["l_returnflag"],
        {
            "parts": F.approx_count_distinct("l_partkey"),
            "median_price": F.percentile_approx("l_extendedprice", 0.5),
        },
    )


@query("""
    SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_price,
           round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price,
           round(quantile_cont(l_quantity, 0.25), 4) AS p25_qty
    FROM lineitem GROUP BY 1
""")
def percentiles(spark, folder):
    wanted = {
        "median_price": ("l_extendedprice", 0.5),
        "p90_price": ("l_extendedprice", 0.9),
        "p25_qty": ("l_quantity", 0.25),
    }
    out = agg.percentiles(table(spark, folder, "lineitem"), ["l_returnflag"], wanted)
    return out.withColumns({n: F.round(n, 4) for n in wanted})


@query("""
    SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_samp(p_retailprice), 3) AS vr,
           round(stddev_pop(p_retailprice), 4) AS sdp, round(var_pop(p_retailprice), 3) AS vrp,
           round(corr(p_size, p_retailprice), 6) AS cr, round(covar_samp(p_size, p_retailprice), 4) AS cv,
           round(covar_pop(p_size, p_retailprice), 4) AS cvp
    FROM part GROUP BY 1
""")
def statistics(spark, folder):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return worksheet(
        table(spark, folder, "part"),
        ["p_brand"],
        {
            "sd": F.round(F.stddev_samp(price), 4),
            "vr": F.round(F.var_samp(price), 3),
            "sdp": F.round(F.stddev_pop(price), 4),
            "vrp": F.round(F.var_pop(price), 3),
            "cr": F.round(F.corr(size, price), 6),
            "cv": F.round(F.covar_samp(size, price), 4),
            "cvp": F.round(F.covar_pop(size, price), 4),
        },
    )


@query("""
    SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status,
           CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS INTEGER) END AS yr
    FROM orders GROUP BY 1
""")
def attr_values(spark, folder):
    yr = date_part("year", F.col("o_orderdate"))
    return worksheet(
        table(spark, folder, "orders"),
        ["o_custkey"],
        {"status": agg.attr("o_orderstatus"), "yr": agg.attr(yr)},
    )


@query("""
    SELECT c_nationkey, CAST(0 AS BIGINT) AS chunk,
           array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS segments FROM customer GROUP BY 1
""")
def collect_distinct(spark, folder):
    out = agg.collect_values(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment")
    return out.select("c_nationkey", "chunk", F.array_join("c_mktsegment", "|").alias("segments"))


@query("""
    WITH n AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i FROM part)
    SELECT p_brand, CAST(i // 40 AS BIGINT) AS chunk, array_to_string(list_sort(list(p_size)), '|') AS sizes
    FROM n GROUP BY ALL
""")
def collect_all(spark, folder):
    out = agg.collect_values(
        table(spark, folder, "part"), ["p_brand"], "p_size", distinct=False, chunk=40
    )
    return out.select("p_brand", "chunk", F.array_join("p_size", "|").alias("sizes"))


@query("""
    SELECT o_orderpriority, round(count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) * 1.0 / count(o_orderkey), 6) AS done_rate,
           count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS big
    FROM orders GROUP BY 1
""")
def conditional_aggregates(spark, folder):
    done = F.count(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return worksheet(
        table(spark, folder, "orders"),
        ["o_orderpriority"],
        {
            "done_rate": F.round(agg.ratio(done, F.count("o_orderkey")), 6),
            "big": agg.count_where(F.col("o_totalprice") > 250000),
        },
    )


@query("""
    SELECT l_shipmode_year, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS discount_rate,
           round(sum(l_extendedprice - l_extendedprice * l_discount), 2) AS net
    FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipmode_year FROM lineitem) GROUP BY 1
""")
def ratio_of_sums(spark, folder):
    price, given = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    return worksheet(
        table(spark, folder, "lineitem"),
        [("l_shipmode_year", date_part("year", F.col("l_shipdate")))],
        {
            "discount_rate": F.round(agg.ratio(F.sum(given), F.sum(price)), 8),
            "net": F.round(F.sum(price - given), 2),
        },
    )


def orders_metrics(spark, folder) -> MetricView:
    nation = table(spark, folder, "nation")
    return MetricView(
        source=table(spark, folder, "orders"),
        dimensions={
            "priority": Dimension(F.col("o_orderpriority")),
            "year": Dimension(date_part("year", F.col("o_orderdate"))),
            "segment": Dimension(F.col("c_mktsegment"), "customer"),
            "nation": Dimension(F.col("n_name"), "nation"),
        },
        measures={
            "total_orders": F.count_distinct("o_orderkey"),
            "avg_value": agg.ratio(F.round(F.sum("o_totalprice"), 2), F.count("o_totalprice")),
            "open_rate": F.round(
                agg.ratio(agg.count_where(F.col("o_orderstatus") == "O"), F.count("o_orderkey")), 6
            ),
        },
        lookups={
            "customer": Lookup(table(spark, folder, "customer"), {"o_custkey": "c_custkey"}),
            "nation": Lookup(nation, {"c_nationkey": "n_nationkey"}, after="customer"),
        },
    )


@query("""
    SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS "year", count(DISTINCT o_orderkey) AS total_orders,
           round(sum(o_totalprice), 2) / count(o_totalprice) AS avg_value, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(o_orderkey), 6) AS open_rate
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND o_totalprice > 5000 GROUP BY ALL
""")
def metric_view_orders(spark, folder):
    return orders_metrics(spark, folder).query(
        ["nation", "year"],
        ["total_orders", "avg_value", "open_rate"],
        filters=[("segment", lambda c: c.isin("BUILDING", "HOUSEHOLD"))],
        where=[F.col("o_totalprice") > 5000],
    )


@query("""
    SELECT count(DISTINCT o_orderkey) AS total_orders, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(o_orderkey), 6) AS open_rate
    FROM orders
""")
def metric_view_total(spark, folder):
    return orders_metrics(spark, folder).query([], ["total_orders", "open_rate"])


@query("""
    SELECT r_name, n_name, c_mktsegment, CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS level,
           count(*) AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
""")
def rollup_geo(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    region = table(spark, folder, "region")
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(
        region, nation["n_regionkey"] == region["r_regionkey"]
    )
    return agg.rollup_totals(
        rows,
        ["r_name", "n_name", "c_mktsegment"],
        {"n": F.count(F.lit(1)), "balance": F.round(F.sum("c_acctbal"), 2)},
    )


@query("""
    SELECT o_orderpriority, o_orderstatus,
      CASE WHEN grouping(o_orderpriority) = 0 AND grouping(o_orderstatus) = 0 THEN 'cell'
           WHEN grouping(o_orderpriority) = 0 THEN 'row_total'
           WHEN grouping(o_orderstatus) = 0 THEN 'column_total' ELSE 'grand_total' END AS level,
      count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), (o_orderstatus), ())
""")
def pivot_sets(spark, folder):
    return agg.pivot_sets(
        table(spark, folder, "orders"),
        ["o_orderpriority"],
        ["o_orderstatus"],
        {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)},
    )


@query("""
    SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def preaggregated_passthrough(spark, folder):
    view = worksheet(
        table(spark, folder, "orders"), ["o_orderpriority"], {"total": F.round(F.sum("o_totalprice"), 2)}
    )
    return worksheet(view, ["o_orderpriority"], {"total": F.sum("total")}, preaggregated=True)


def region_sales(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


_REGION_SALES = """
    j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query("WITH " + _REGION_SALES + """
    SELECT r_name, n_name, CAST(2 - grouping(r_name) - grouping(n_name) AS INTEGER) AS level, round(sum(o_totalprice), 2) AS sales,
           count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities
    FROM j GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_countd(spark, folder):
    measures = {"sales": F.round(F.sum("o_totalprice"), 2)}
    distinct = {"customers": "o_custkey", "priorities": "o_orderpriority"}
    return agg.rollup_distinct(region_sales(spark, folder), ["r_name", "n_name"], measures, distinct)


@query("WITH " + _REGION_SALES + """
    SELECT r_name, o_orderstatus, CASE WHEN grouping(r_name) = 0 AND grouping(o_orderstatus) = 0 THEN 'cell' WHEN grouping(r_name) = 0 THEN 'row_total'
             WHEN grouping(o_orderstatus) = 0 THEN 'column_total' ELSE 'grand_total' END AS level, count(*) AS n, count(DISTINCT o_custkey) AS customers
    FROM j GROUP BY GROUPING SETS ((r_name, o_orderstatus), (r_name), (o_orderstatus), ())
""")
def pivot_countd(spark, folder):
    rows = region_sales(spark, folder)
    return agg.pivot_distinct(rows, ["r_name"], ["o_orderstatus"], {"n": F.count(F.lit(1))}, {"customers": "o_custkey"})


@query("WITH " + _REGION_SALES + """
    SELECT DISTINCT 'nation' AS grain, n_name AS member, true AS distinct_near, true AS median_near, true AS p90_near FROM j
    UNION ALL SELECT DISTINCT 'region', r_name, true, true, true FROM j UNION ALL SELECT 'all', 'all', true, true, true
""")
def sketches_at_three_grains(spark, folder):
    """One stored table of sketches, merged to three grains, each within tolerance of exact."""
    rows = region_sales(spark, folder).withColumn("every", F.lit("all"))
    stored = settle(sketches.sketched(rows, ["every", "r_name", "n_name", "o_orderstatus"], {"u": "o_custkey"}, {"q": "o_totalprice"}))
    out = None
    for grain, member in (("nation", "n_name"), ("region", "r_name"), ("all", "every")):
        near = sketches.merged(stored, [member], ["u"], ["q"]).select(
            F.col(member).alias("member"), sketches.distinct_of("u").alias("u"),
            *[sketches.quantile_of("q", p).alias(n) for n, p in (("q50", 0.5), ("q90", 0.9))],
        )
        exact = rows.join(near, F.col(member) == F.col("member")).groupBy(F.lit(grain).alias("grain"), "member").agg(
            (F.abs(F.count_distinct("o_custkey") / F.first("u") - 1) <= 0.04).alias("distinct_near"),
            *[
                (F.abs(F.avg((F.col("o_totalprice") <= F.col(q)).cast("double")) - p) <= 0.03).alias(name)
                for q, p, name in (("q50", 0.5, "median_near"), ("q90", 0.9, "p90_near"))
            ],
        )
        out = exact if out is None else out.unionByName(exact)
    return out


@query("SELECT DISTINCT l_returnflag, true AS parts_near, true AS median_near FROM lineitem")
def approximate_within_tolerance(spark, folder):
    """The approximate aggregates of each flag beside the exact ones.

    Each has a grouping of its own: beside a distinct count in one grouping, Spark keeps the
    sketches and the values of a percentile for every part of a flag.
    """
    lines, flag = table(spark, folder, "lineitem"), ["l_returnflag"]
    near = worksheet(
        lines, flag, {"near": F.approx_count_distinct("l_partkey", 0.02), "median_near": F.percentile_approx("l_extendedprice", 0.5)}
    )
    exact = worksheet(lines, flag, {"exact": F.count_distinct("l_partkey")})
    spread = agg.percentiles(lines, flag, {"low": ("l_extendedprice", 0.49), "high": ("l_extendedprice", 0.51)})
    both = attach(attach(near, exact, flag), spread, flag)
    return both.select(
        "l_returnflag",
        (F.abs(F.col("near") / F.col("exact") - 1) <= 0.08).alias("parts_near"),
        F.col("median_near").between(F.col("low"), F.col("high")).alias("median_near"),
    )
