"""Filters and predicates."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.operators import filters as f
from viewgrain.operators.lod import fixed
from viewgrain.operators.tablecalc import index, percent_of_total
from viewgrain.operators.view import OrderOfOperations, worksheet


def row_count():
    return {"n": F.count(F.lit(1))}

ANCHOR = dt.date(2024, 1, 30)


def customer_nation(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])


@query("""
    SELECT c_mktsegment, count(*) AS n FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_mktsegment IS NULL GROUP BY 1
""")
def include_members(spark, folder):
    keep = f.isin_members("c_mktsegment", ["BUILDING", "MACHINERY", "%null%"])
    return worksheet(table(spark, folder, "customer"), ["c_mktsegment"], row_count(), [keep])


@query("""
    SELECT p_type, p_size, count(*) AS n FROM part
    WHERE p_type NOT IN ('ECONOMY', 'PROMO') AND p_type IS NOT NULL AND p_size NOT IN (1, 2, 3) GROUP BY ALL
""")
def exclude_members(spark, folder):
    drop = [f.notin_members("p_type", ["ECONOMY", "PROMO", None]), f.notin_members("p_size", [1, 2, 3])]
    return worksheet(table(spark, folder, "part"), ["p_type", "p_size"], row_count(), drop)


@query("""
    SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE NOT (c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3'))
    GROUP BY ALL
""")
def exclude_tuples(spark, folder):
    drop = f.exclude_tuples(
        {"c_mktsegment": ["BUILDING", "HOUSEHOLD"], "n_name": ["NATION_1", "NATION_2", "NATION_3"]}
    )
    return worksheet(customer_nation(spark, folder), ["c_mktsegment", "n_name"], row_count(), [drop])


@query("""
    SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE NOT ((c_mktsegment IN ('BUILDING') AND n_name IN ('NATION_1', 'NATION_2'))
            OR (c_mktsegment IN ('FURNITURE', 'MACHINERY') AND n_name IN ('NATION_7')))
    GROUP BY ALL
""")
def exclude_union(spark, folder):
    drop = f.exclude_tuple_union(
        [
            {"c_mktsegment": ["BUILDING"], "n_name": ["NATION_1", "NATION_2"]},
            {"c_mktsegment": ["FURNITURE", "MACHINERY"], "n_name": ["NATION_7"]},
        ]
    )
    return worksheet(customer_nation(spark, folder), ["c_mktsegment", "n_name"], row_count(), [drop])


@query("""
    SELECT p_size, count(*) AS n FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_retailprice <= 1500 GROUP BY 1
""")
def range_filter(spark, folder):
    keep = [f.in_range("p_size", 10, 20), f.in_range("p_retailprice", hi=1500.0)]
    return worksheet(table(spark, folder, "part"), ["p_size"], row_count(), keep)


@query("""
    SELECT span, event_type, count(*) AS n FROM (
      SELECT 'last 7 days' AS span, * FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'
      UNION ALL
      SELECT 'last 2 weeks', * FROM events WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-02-05'
      UNION ALL
      SELECT 'last month', * FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'
      UNION ALL
      SELECT 'next day', * FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31'
    ) GROUP BY ALL
""")
def relative_date(spark, folder):
    events = table(spark, folder, "events")
    spans = {"last 7 days": ("day", 7), "last 2 weeks": ("week", 2), "last month": ("month", 1), "next day": ("day", -1)}
    out = None
    for label, (unit, n) in spans.items():
        keep = f.relative_date("ts", unit, n, ANCHOR)
        part = worksheet(events, [("span", F.lit(label)), "event_type"], row_count(), [keep])
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT mode, p_name, count(*) AS n FROM (
      SELECT 'contains' AS mode, p_name FROM part WHERE contains(p_name, 'ed w')
      UNION ALL SELECT 'starts', p_name FROM part WHERE starts_with(p_name, 'small')
      UNION ALL SELECT 'ends', p_name FROM part WHERE ends_with(p_name, 'ring')
      UNION ALL SELECT 'exact', p_name FROM part WHERE p_name = 'red widget'
      UNION ALL SELECT 'literal', p_name FROM part WHERE contains(p_name, '%')
    ) GROUP BY ALL
""")
def wildcards(spark, folder):
    part = table(spark, folder, "part")
    modes = {
        "contains": f.wildcard("p_name", "contains", "ed w"),
        "starts": f.wildcard("p_name", "starts", "small"),
        "ends": f.wildcard("p_name", "ends", "ring"),
        "exact": f.wildcard("p_name", "exact", "red widget"),
        "literal": f.wildcard("p_name", "contains", "%"),
    }
    # One pass: each row goes to the modes it passes.
    passed = F.filter(
        F.array(*[F.when(keep, F.lit(mode)) for mode, keep in modes.items()]), lambda m: m.isNotNull()
    )
    return worksheet(part.select("p_name", F.explode(passed).alias("mode")), ["mode", "p_name"], row_count())


@query("""
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1
""")
def year_as_range(spark, folder):
    return worksheet(
        table(spark, folder, "orders"),
        ["o_orderstatus"],
        {**row_count(), "total": F.round(F.sum("o_totalprice"), 2)},
        [f.in_year("o_orderdate", 1997)],
    )


@query("""
    SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
    HAVING round(sum(o_totalprice), 2) > 3000000
""")
def measure_filter(spark, folder):
    return worksheet(
        table(spark, folder, "orders"),
        ["o_custkey"],
        {"total": F.round(F.sum("o_totalprice"), 2)},
        having=[F.col("total") > 3000000],
    )


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 17)
""")
def condition_members(spark, folder):
    rows = f.condition_members(
        table(spark, folder, "orders"), "o_custkey", F.count(F.lit(1)), lambda n: n >= 17
    )
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
    WITH t AS (SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM orders GROUP BY 1)
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM t WHERE rk <= 10) GROUP BY 1
""")
def top_customers(spark, folder):
    rows = f.top_members(table(spark, folder, "orders"), "o_custkey", F.count(F.lit(1)), 10)
    return worksheet(rows, ["o_custkey"], {**row_count(), "total": F.round(F.sum("o_totalprice"), 2)})


@query("""
    WITH t AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 7)
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM t) GROUP BY 1
""")
def bottom_customers_strict(spark, folder):
    rows = f.top_members(
        table(spark, folder, "orders"), "o_custkey", F.round(F.sum("o_totalprice"), 2), 7,
        ascending=True, ties="strict",
    )
    return worksheet(rows, ["o_custkey"], {**row_count(), "total": F.round(F.sum("o_totalprice"), 2)})


@query("""
    SELECT side, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
      SELECT 'in' AS side, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
      UNION ALL
      SELECT 'out', o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    ) GROUP BY 1
""")
def set_filters(spark, folder):
    members = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, folder, "orders")
    out = None
    for side, invert in (("in", False), ("out", True)):
        rows = f.set_filter(orders, "o_custkey", members, invert)
        part = worksheet(rows, [("side", F.lit(side))], {**row_count(), "total": F.round(F.sum("o_totalprice"), 2)})
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT p_name, p_size, p_retailprice FROM part WHERE p_brand = 'Brand#7'
""")
def page_of_brand(spark, folder):
    return f.page_filter(table(spark, folder, "part"), "p_brand", "Brand#7").select("p_name", "p_size", "p_retailprice")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def filter_domain(spark, folder):
    return f.filter_domain(table(spark, folder, "orders"), "o_orderpriority")


@query("""
    SELECT p_brand, count(*) AS total_rows,
           CAST(count(*) FILTER (WHERE p_size <= 15 AND p_type = 'PROMO') AS BIGINT) AS associated_rows
    FROM part GROUP BY 1
""")
def filter_associativity(spark, folder):
    other = [F.col("p_size") <= 15, F.col("p_type") == "PROMO"]
    return f.filter_associativity(table(spark, folder, "part"), "p_brand", other)


@query("""
    SELECT 'customer' AS dataset, count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 3)
    UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey IN (1, 2, 3)
    UNION ALL SELECT 'orders', count(*) FROM orders
""")
def cross_filter(spark, folder):
    frames = {
        "customer": table(spark, folder, "customer").withColumnRenamed("c_nationkey", "nationkey"),
        "supplier": table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "nationkey"),
        "orders": table(spark, folder, "orders"),
    }
    out = None
    for name, df in f.cross_filter(frames, {"nationkey": [1, 2, 3]}).items():
        part = worksheet(df, [], row_count()).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
    WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name = 'Supplier#000000003'
                          OR s_acctbal > 9000) GROUP BY 1
""")
def entitlement(spark, folder):
    principal = F.when(F.col("s_acctbal") > 9000, F.lit("managers")).otherwise(F.col("s_name"))
    grants = table(spark, folder, "supplier").select(
        principal.alias("principal"), F.col("s_nationkey").alias("c_nationkey")
    )
    own = table(spark, folder, "supplier").select(
        F.col("s_name").alias("principal"), F.col("s_nationkey").alias("c_nationkey")
    )
    rows = f.entitlement_filter(
        table(spark, folder, "customer"), "c_nationkey", grants.union(own),
        user="Supplier#000000003", groups=["managers"],
    )
    return worksheet(rows, ["c_mktsegment"], {**row_count(), "balance": F.round(F.sum("c_acctbal"), 2)})


@query("""
    WITH ctx AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_totalprice > 1000),
    fx AS (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS customer_total FROM ctx),
    tm AS (SELECT o_custkey FROM (SELECT o_custkey, rank() OVER (ORDER BY count(*) DESC) AS rk FROM ctx GROUP BY 1) WHERE rk <= 200),
    d AS (SELECT * FROM fx WHERE o_custkey IN (SELECT o_custkey FROM tm) AND o_orderstatus IN ('F', 'O')),
    v AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total,
                 round(max(customer_total), 2) AS best_customer FROM d GROUP BY ALL HAVING count(*) > 10),
    w AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY total DESC, o_orderpriority) AS place FROM v)
    SELECT o_orderpriority, o_orderstatus, n, total, best_customer, CAST(place AS BIGINT) AS place FROM w WHERE place <= 3
""")
def order_of_operations(spark, folder):
    def top_of_context(rows, context):
        members = f.rank_members(context, "o_custkey", F.count(F.lit(1)), 200)
        return f.keep_members(rows, "o_custkey", members.select("o_custkey"))

    view = OrderOfOperations(
        dims=["o_orderpriority", "o_orderstatus"],
        measures={
            **row_count(),
            "total": F.round(F.sum("o_totalprice"), 2),
            "best_customer": F.round(F.max("customer_total"), 2),
        },
        source=[F.col("o_totalprice") > 1000],
        context=[F.col("o_orderdate") >= F.lit(dt.date(1996, 1, 1))],
        fixed=[partial(fixed, dims=["o_custkey"], values={"customer_total": F.sum("o_totalprice")})],
        members=[top_of_context],
        dimension=[f.isin_members("o_orderstatus", ["F", "O"])],
        measure=[F.col("n") > 10],
        table_calcs=[
            partial(index, name="place", partition=["o_orderstatus"], order=["-total", "o_orderpriority"])
        ],
        table_calc_filter=[F.col("place") <= 3],
    )
    return view.apply(table(spark, folder, "orders"))


@query("""
    WITH v AS (SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1)
    SELECT * FROM (SELECT c_mktsegment, n, round(n / sum(n) OVER (), 6) AS share FROM v) WHERE n > 290
""")
def table_calc_filter(spark, folder):
    view = worksheet(table(spark, folder, "customer"), ["c_mktsegment"], row_count())
    shares = percent_of_total(view, "n", "share", [])
    return shares.withColumn("share", F.round("share", 6)).where("n > 290")


@query("""
    WITH j AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS yr,
                      coalesce(o_orderstatus IN ('F', 'P'), false) AS a, coalesce(c_mktsegment = 'BUILDING', false) AS b, coalesce(o_totalprice > 100000, false) AS c
               FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'o_orderstatus' AS control, o_orderstatus AS value, count(*) AS total_rows, count(*) FILTER (WHERE b AND c) AS associated_rows FROM j GROUP BY 2
    UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*), count(*) FILTER (WHERE a AND c) FROM j GROUP BY 2
    UNION ALL SELECT 'yr', CAST(yr AS VARCHAR), count(*), count(*) FILTER (WHERE a AND b) FROM j GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(*) FILTER (WHERE a AND b AND c) FROM j GROUP BY 2
""")
def associativity_all(spark, folder):
    """Four filter controls, each counted under the choices of the others."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).withColumn("yr", F.year("o_orderdate"))
    return f.associativity(
        rows,
        {
            "o_orderstatus": f.isin_members(F.col("o_orderstatus"), ["F", "P"]),
            "c_mktsegment": F.col("c_mktsegment") == "BUILDING",
            "yr": F.col("o_totalprice") > 100000,  # any predicate may stand behind a control
            "o_orderpriority": None,
        },
    )
