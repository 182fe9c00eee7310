"""Views, joins and models."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.functions.dates import date_part, date_trunc
from viewgrain.functions.numbers import bin_numeric
from viewgrain.operators.filters import date_range, entitlement_filter, in_range, isin_members, user_domain
from viewgrain.operators.joins import (
    Model,
    blend,
    join_rank_back,
    lookup_join,
    overlap_join,
    physical_join,
)
from viewgrain.operators.reshape import group_members, recode, recode_from, set_flag
from viewgrain.operators.view import detail, manual_order, top_rows, with_calc, worksheet
from viewgrain.plans.settle import settle
from viewgrain.sources import create_table_as, custom_query, read_table


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def sales_model(spark, folder) -> Model:
    """lineitem with everything that hangs on it."""
    names = ["lineitem", "orders", "customer", "nation", "region", "part", "supplier"]
    model = Model("lineitem", {n: table(spark, folder, n) for n in names})
    model.relate("lineitem", "orders", {"l_orderkey": "o_orderkey"})
    model.relate("orders", "customer", {"o_custkey": "c_custkey"})
    model.relate("customer", "nation", {"c_nationkey": "n_nationkey"})
    model.relate("nation", "region", {"n_regionkey": "r_regionkey"})
    model.relate("lineitem", "part", {"l_partkey": "p_partkey"})
    return model.relate("lineitem", "supplier", {"l_suppkey": "s_suppkey"})


@query("""
    SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS yr,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA') AND o_orderdate >= DATE '1996-01-01'
      AND o_orderdate < DATE '1999-01-01'
    GROUP BY 1, 2 ORDER BY revenue DESC LIMIT 8
""")
def ws_region_year(spark, folder):
    rows = sales_model(spark, folder).view(["r_name", "o_orderdate", "l_extendedprice", "l_discount"])
    return worksheet(
        rows,
        ["r_name", ("yr", date_part("year", F.col("o_orderdate")))],
        {"revenue": F.round(F.sum(revenue()), 2), "n": F.count(F.lit(1))},
        filters=[
            isin_members("r_name", ["ASIA", "EUROPE", "AMERICA"]),
            date_range("o_orderdate", dt.date(1996, 1, 1), dt.date(1999, 1, 1)),
        ],
        sorts=[F.col("revenue").desc()],
        top=8,
    )


@query("""
    SELECT how, count(*) AS n, count(c_custkey) AS customers, count(o_orderkey) AS orders,
           round(sum(o_totalprice), 2) AS total
    FROM (
      SELECT 'inner' AS how, c_custkey, o_orderkey, o_totalprice
      FROM customer c JOIN
           orders o ON c_custkey = o_custkey
      UNION ALL
      SELECT 'left', c_custkey, o_orderkey, o_totalprice
      FROM customer c LEFT JOIN
           orders o ON c_custkey = o_custkey
      UNION ALL
      SELECT 'right', c_custkey, o_orderkey, o_totalprice
      FROM customer c RIGHT JOIN
           orders o ON c_custkey = o_custkey
      UNION ALL
      SELECT 'full', c_custkey, o_orderkey, o_totalprice
      FROM customer c FULL JOIN
           orders o ON c_custkey = o_custkey
    ) GROUP BY how
""")
def join_types(spark, folder):
    customer = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    out = None
    for how in ("inner", "left", "right", "full"):
        joined = physical_join(customer, orders, {"c_custkey": "o_custkey"}, how)
        part = joined.agg(
            F.count(F.lit(1)).alias("n"),
            F.count("c_custkey").alias("customers"),
            F.count("o_orderkey").alias("orders"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
        ).withColumn("how", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def culled_model(spark, folder):
    names = ["orders", "customer", "nation", "region"]
    model = Model("orders", {n: table(spark, folder, n) for n in names})
    model.relate("orders", "customer", {"o_custkey": "c_custkey"})
    model.relate("customer", "nation", {"c_nationkey": "n_nationkey"})
    model.relate("nation", "region", {"n_regionkey": "r_regionkey"})
    return worksheet(
        model.view(["c_mktsegment", "o_totalprice"]),
        ["c_mktsegment"],
        {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)},
    )


@query("""
    SELECT c_custkey, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total
    FROM customer LEFT JOIN orders o ON c_custkey = o_custkey
    GROUP BY 1
""")
def model_keep_unmatched(spark, folder):
    orders = table(spark, folder, "orders")
    model = Model("customer", {"customer": table(spark, folder, "customer"), "orders": orders}, keep_unmatched=True)
    model.relate("orders", "customer", {"o_custkey": "c_custkey"})
    rows = model.view(["c_custkey", "o_orderkey", "o_totalprice"])
    return worksheet(
        rows, ["c_custkey"], {"n": F.count("o_orderkey"), "total": F.round(F.sum("o_totalprice"), 2)}
    )


@query("""
    SELECT n_name, count(*) AS n, count(DISTINCT c_custkey) AS customers, round(sum(l_extendedprice), 2) AS sales
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey GROUP BY 1
""")
def model_circle(spark, folder):
    names = ["lineitem", "orders", "customer", "supplier", "nation"]
    model = Model("lineitem", {name: table(spark, folder, name) for name in names})
    model.relate("lineitem", "orders", {"l_orderkey": "o_orderkey"}).relate("orders", "customer", {"o_custkey": "c_custkey"})
    model.relate("lineitem", "supplier", {"l_suppkey": "s_suppkey"}).relate("supplier", "nation", {"s_nationkey": "n_nationkey"})
    model.relate("customer", "nation", {"c_nationkey": "n_nationkey"})
    measures = {"n": F.count(F.lit(1)), "customers": F.count_distinct("c_custkey"), "sales": F.round(F.sum("l_extendedprice"), 2)}
    return worksheet(model.view(["n_name", "c_custkey", "l_extendedprice"]), ["n_name"], measures)


@query("""
    SELECT p_brand, n_name, count(*) AS n, count(DISTINCT s_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey AND p_size = n_nationkey GROUP BY ALL
""")
def model_many_to_many_circle(spark, folder):
    """Parts of a size for each nation: many parts to a nation, many suppliers to it."""
    names = ["lineitem", "part", "supplier", "nation"]
    model = Model("lineitem", {name: table(spark, folder, name) for name in names})
    model.relate("lineitem", "part", {"l_partkey": "p_partkey"}).relate("part", "nation", {"p_size": "n_nationkey"})
    model.relate("lineitem", "supplier", {"l_suppkey": "s_suppkey"}).relate("supplier", "nation", {"s_nationkey": "n_nationkey"})
    rows = model.view(["p_brand", "n_name", "s_suppkey", "l_quantity"])
    measures = {"n": F.count(F.lit(1)), "suppliers": F.count_distinct("s_suppkey"), "qty": F.round(F.sum("l_quantity"), 2)}
    return worksheet(rows, ["p_brand", "n_name"], measures)


@query("""
    SELECT l_returnflag, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines
    FROM lineitem JOIN (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS lines FROM lineitem GROUP BY ALL)
      ON l_partkey = p AND l_suppkey = s
    GROUP BY 1
""")
def composite_relationship(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    pairs = lineitem.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    model = Model("lineitem", {"lineitem": lineitem, "pairs": pairs})
    model.relate("lineitem", "pairs", {"l_partkey": "p"}).relate("pairs", "lineitem", {"s": "l_suppkey"})
    rows = model.view(["l_returnflag", "lines"])
    return worksheet(rows, ["l_returnflag"], {"n": F.count(F.lit(1)), "lines": F.sum("lines")})


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
    WHERE l_quantity >= 45 AND l_returnflag = 'R'
""")
def detail_rows(spark, folder):
    return detail(
        table(spark, folder, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"],
        [in_range("l_quantity", lo=45.0), isin_members("l_returnflag", ["R"])],
    )


@query("""
    SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS avg_charge,
           round(max(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS max_charge
    FROM lineitem GROUP BY 1
""")
def calculated_field(spark, folder):
    rows = with_calc(table(spark, folder, "lineitem"), "charge", revenue() * (1 + F.col("l_tax")))
    return worksheet(
        rows,
        ["l_returnflag"],
        {"avg_charge": F.round(F.avg("charge"), 4), "max_charge": F.round(F.max("charge"), 4)},
    )


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(quarter(o_orderdate) AS INTEGER) AS qr,
           CAST(month(o_orderdate) AS INTEGER) AS mn, CAST(weekofyear(o_orderdate) AS INTEGER) AS wk,
           CAST(day(o_orderdate) AS INTEGER) AS dy, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS wd,
           count(*) AS n
    FROM orders GROUP BY ALL
""")
def date_part_dims(spark, folder):
    d = F.col("o_orderdate")
    parts = {"yr": "year", "qr": "quarter", "mn": "month", "wk": "week", "dy": "day", "wd": "weekday"}
    dims = [(name, date_part(part, d)) for name, part in parts.items()]
    return worksheet(table(spark, folder, "orders"), dims, {"n": F.count(F.lit(1))})


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS tyr, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS tqr,
           CAST(date_trunc('month', o_orderdate) AS DATE) AS tmn, CAST(date_trunc('week', o_orderdate) AS DATE) AS twk,
           CAST(date_trunc('day', o_orderdate) AS DATE) AS tdy, count(*) AS n
    FROM orders GROUP BY ALL
""")
def date_trunc_dims(spark, folder):
    d = F.col("o_orderdate")
    parts = {"tqr": "quarter", "tmn": "month", "twk": "week", "tdy": "day"}
    dims = [("tyr", date_trunc("year", d))]
    dims += [(name, date_trunc(part, d).cast("date")) for name, part in parts.items()]
    return worksheet(table(spark, folder, "orders"), dims, {"n": F.count(F.lit(1))})


@query("""
    SELECT CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS o_orderstatus,
           count(*) AS n FROM orders GROUP BY 1
""")
def recode_aliases(spark, folder):
    rows = recode(table(spark, folder, "orders"), "o_orderstatus", {"F": "Finished", "O": "Open"})
    return worksheet(rows, ["o_orderstatus"], {"n": F.count(F.lit(1))})


@query("""
    SELECT coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS supplier, count(*) AS n
    FROM (SELECT * FROM lineitem) LEFT JOIN (SELECT s_suppkey, s_name FROM supplier) ON l_suppkey = s_suppkey
    GROUP BY 1
""")
def recode_from_table(spark, folder):
    aliases = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("value"), "s_name"
    )
    counts = worksheet(
        table(spark, folder, "lineitem"), [("supplier", F.col("l_suppkey").cast("string"))], {"n": F.count(F.lit(1))}
    )
    return recode_from(counts, "supplier", aliases)


@query("""
    SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Industry'
                WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Home' ELSE 'Rest' END AS sector,
           count(*) AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer GROUP BY 1
""")
def member_groups(spark, folder):
    rows = group_members(
        table(spark, folder, "customer"),
        "c_mktsegment",
        {"Industry": ["AUTOMOBILE", "MACHINERY"], "Home": ["FURNITURE", "HOUSEHOLD"]},
        "sector",
        other="Rest",
    )
    return worksheet(rows, ["sector"], {"n": F.count(F.lit(1)), "balance": F.round(F.sum("c_acctbal"), 2)})


@query("""
    SELECT CAST(floor(c_acctbal / 500.0) * 500.0 AS DOUBLE) AS bin, count(*) AS n FROM customer GROUP BY 1
""")
def numeric_bins(spark, folder):
    return worksheet(
        table(spark, folder, "customer"), [("bin", bin_numeric("c_acctbal", 500.0))], {"n": F.count(F.lit(1))}
    )


@query("""
    SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS in_set,
           count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1
""")
def set_in_out(spark, folder):
    rich = table(spark, folder, "customer").where("c_acctbal > 5000").select("c_custkey")
    rows = set_flag(table(spark, folder, "orders"), "o_custkey", rich, "in_set")
    return worksheet(rows, ["in_set"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)})


@query("""
    SELECT p_brand, p_type, p_size, count(*) AS n, round(avg(p_retailprice), 6) AS avg_price
    FROM part GROUP BY ALL
""")
def encoding_channels(spark, folder):
    return worksheet(
        table(spark, folder, "part"),
        ["p_brand"],
        channels={
            "color": ["p_type"],
            "detail": ["p_size"],
            "size": {"n": F.count(F.lit(1))},
            "label": {"avg_price": F.round(F.avg("p_retailprice"), 6)},
        },
    )


@query("""
    SELECT s_name, n_name, count(*) AS n
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
    GROUP BY ALL
""")
def lookup_many_to_one(spark, folder):
    rows = lookup_join(table(spark, folder, "lineitem"), table(spark, folder, "supplier"), {"l_suppkey": "s_suppkey"})
    rows = lookup_join(rows, table(spark, folder, "nation"), {"s_nationkey": "n_nationkey"})
    return worksheet(rows, ["s_name", "n_name"], {"n": F.count(F.lit(1))})


@query("""
    SELECT a.k, a.customers, b.suppliers, round(b.balance, 2) AS balance
    FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a
    LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers, sum(s_acctbal) AS balance
               FROM supplier GROUP BY 1) b ON a.k = b.k
""")
def blended(spark, folder):
    primary = worksheet(
        table(spark, folder, "customer"), [("k", F.col("c_nationkey"))], {"customers": F.count(F.lit(1))}
    )
    secondary = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "k")
    return blend(
        primary, secondary, ["k"],
        {"suppliers": F.count(F.lit(1)), "balance": F.round(F.sum("s_acctbal"), 2)},
    )


@query("""
    SELECT p_brand, CAST(brand_rank AS INTEGER) AS brand_rank, count(*) AS n
    FROM part JOIN (
      SELECT p_brand AS b, dense_rank() OVER (ORDER BY count(DISTINCT p_partkey) DESC) AS brand_rank
      FROM part GROUP BY 1) ON p_brand = b
    GROUP BY ALL
""")
def rank_joined_back(spark, folder):
    ranked = join_rank_back(table(spark, folder, "part"), "p_brand", F.count_distinct("p_partkey"), "brand_rank")
    return worksheet(
        ranked, ["p_brand", "brand_rank"], {"n": F.count(F.lit(1))}
    )


@query("""
    WITH s AS (SELECT user_id, event_id, ts AS start_ts, ts + INTERVAL 10 MINUTE AS end_ts FROM events)
    SELECT a.user_id, a.event_id AS event_id_1, b.event_id AS event_id_2
    FROM s a JOIN s b ON a.user_id = b.user_id AND b.start_ts < a.end_ts
     AND (a.start_ts < b.start_ts OR (a.start_ts = b.start_ts AND a.event_id < b.event_id))
""")
def overlapping_intervals(spark, folder):
    spans = table(spark, folder, "events").select(
        "user_id",
        "event_id",
        F.col("ts").cast("timestamp").alias("start_ts"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 MINUTES")).alias("end_ts"),
    )
    pairs = overlap_join(spans, "start_ts", "end_ts", ["user_id"], "event_id")
    return pairs.select("user_id", "event_id_1", "event_id_2")


@query("""
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC
""")
def field_sort(spark, folder):
    return worksheet(
        table(spark, folder, "orders"),
        ["o_orderpriority"],
        {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)},
        sorts=[F.col("total").desc()],
    )


@query("""
    SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
    ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey
    LIMIT 50
""")
def manual_sort(spark, folder):
    rows = detail(table(spark, folder, "orders"), ["o_orderpriority", "o_orderkey", "o_totalprice"])
    order = manual_order("o_orderpriority", ["2-HIGH", "5-LOW"])
    return top_rows(rows, [order, F.col("o_totalprice").desc(), F.col("o_orderkey")], 50)


@query("""
    SELECT l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_partkey LIMIT 20
""")
def top_n_rows(spark, folder):
    return worksheet(
        table(spark, folder, "lineitem"),
        ["l_partkey"],
        {"qty": F.round(F.sum("l_quantity"), 2)},
        sorts=[F.col("qty").desc(), F.col("l_partkey")],
        top=20,
    )


@query("""
    SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date FROM orders
""")
def global_aggregate(spark, folder):
    return worksheet(
        table(spark, folder, "orders"),
        [],
        {
            "n": F.count(F.lit(1)),
            "total": F.round(F.sum("o_totalprice"), 2),
            "first_date": F.min("o_orderdate"),
        },
    )


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < current_date) AS before_today FROM orders WHERE o_orderdate <= now() GROUP BY 1")
def today_and_now(spark, folder):
    orders = table(spark, folder, "orders").where(F.col("o_orderdate") <= F.current_timestamp())
    past = F.count_if(F.col("o_orderdate").cast("date") < F.current_date())
    return worksheet(orders, ["o_orderstatus"], {"n": F.count(F.lit(1)), "before_today": past})


@query("""
    SELECT n_name, count(*) AS customers, 'corp.example' AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name LIKE 'N%' OR n_nationkey % 5 = 1 GROUP BY 1
""")
def user_functions(spark, folder):
    """Rows that a user or one of their groups may see, with the domain of the user's name."""
    nation = table(spark, folder, "nation")
    who = F.when(F.col("n_name").startswith("N"), "ann@corp.example").when(F.col("n_nationkey") % 5 == 1, "asia-sales").otherwise("bob@corp.example")
    grants = nation.select(who.alias("principal"), F.col("n_name").alias("n_name"))
    rows = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    seen = entitlement_filter(rows, "n_name", grants, "ann@corp.example", ["asia-sales"])
    return worksheet(seen, ["n_name"], {"customers": F.count(F.lit(1))}).withColumn("domain", user_domain("ann@corp.example"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def table_round_trip(spark, folder):
    """A managed table, written once and left alone the second time, read by its name."""
    name = f"viewgrain_{uuid.uuid4().hex}"
    customer = table(spark, folder, "customer")
    create_table_as(customer, name)
    create_table_as(customer.limit(0), name)
    measures = {"n": F.count(F.lit(1)), "balance": F.round(F.sum("c_acctbal"), 2)}
    kept = settle(worksheet(read_table(spark, name), ["c_mktsegment"], measures))
    spark.sql(f"DROP TABLE {name}")
    return kept


@query("""
    (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT -1 - c_custkey FROM customer WHERE c_acctbal < 0
""")
def custom_set_operations(spark, folder):
    sql = """
        (SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = :one INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = :other)
        EXCEPT SELECT c_custkey FROM {customer} WHERE c_mktsegment = :segment UNION SELECT -1 - c_custkey FROM {customer} WHERE c_acctbal < 0
    """
    args = {"one": "F", "other": "O", "segment": "BUILDING"}
    return custom_query(spark, sql, args, orders=table(spark, folder, "orders"), customer=table(spark, folder, "customer"))
