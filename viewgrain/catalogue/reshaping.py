"""Unpivot, crosstab and set operations; tables read and written as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.operators import reshape
from viewgrain.operators.joins import join_rank_back
from viewgrain.operators.view import worksheet
from viewgrain.plans.settle import shared_folder
from viewgrain.sources import custom_query, export_csv, read_files, safe_names


def prices():
    return {
        "Total_Price": F.round(F.sum("l_extendedprice"), 2),
        "Total_Quantity": F.round(F.sum("l_quantity"), 2),
        "Line_Count": F.count(F.lit(1)),
    }


@query("""
    WITH w AS (SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS p, round(sum(l_quantity), 2) AS q,
                      CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, 'Total Price' AS "Metric", p AS "Value" FROM w
    UNION ALL SELECT l_returnflag, l_linestatus, 'Total Quantity', q FROM w
    UNION ALL SELECT l_returnflag, l_linestatus, 'Line Count', c FROM w
""")
def unpivot_measures(spark, folder):
    return reshape.unpivot_measures(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], prices())


@query("""
    SELECT 'Total Price' AS "Metric", round(sum(l_extendedprice), 2) AS "Value" FROM lineitem
    UNION ALL SELECT 'Total Quantity', round(sum(l_quantity), 2) FROM lineitem
    UNION ALL SELECT 'Line Count', CAST(count(*) AS DOUBLE) FROM lineitem
""")
def unpivot_totals(spark, folder):
    return reshape.unpivot_measures(table(spark, folder, "lineitem"), [], prices())


@query("""
    WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY round(sum(l_extendedprice), 2) + round(sum(l_quantity), 2) DESC, 1 LIMIT 12),
    w AS (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS p, round(sum(l_quantity), 2) AS q FROM lineitem
          WHERE l_suppkey IN (SELECT l_suppkey FROM t) GROUP BY 1)
    SELECT l_suppkey, 'Total Price' AS "Metric", p AS "Value" FROM w
    UNION ALL SELECT l_suppkey, 'Total Quantity', q FROM w
""")
def unpivot_top(spark, folder):
    measures = {n: prices()[n] for n in ("Total_Price", "Total_Quantity")}
    return reshape.unpivot_top(table(spark, folder, "lineitem"), ["l_suppkey"], measures, 12)


@query("""
    SELECT c_nationkey AS nationkey, CAST(c_custkey AS DOUBLE) AS amount, c_name AS name FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal, s_name FROM supplier
""")
def union_aligned(spark, folder):
    customer = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("amount"), F.col("c_name").alias("name")
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"), F.col("s_nationkey").alias("nationkey")
    )
    return reshape.union_all([customer, supplier])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_pairs(spark, folder):
    return reshape.select_distinct(table(spark, folder, "part"), ["p_brand", "p_type"])


@query("""
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 470000),
         b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)
    SELECT 'all' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
    UNION ALL SELECT 'shared', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
    UNION ALL SELECT 'minus', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
""")
def combined_sets(spark, folder):
    orders = table(spark, folder, "orders")
    a = orders.where("o_totalprice > 470000").select(F.col("o_custkey").alias("k"))
    b = orders.where("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    parts = [
        reshape.combine_sets(a, b, op).select(F.lit(op).alias("op"), "k") for op in ("all", "shared", "minus")
    ]
    return reshape.union_all(parts)


@query("""
    SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F",
           round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O",
           round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS "P"
    FROM orders GROUP BY 1
""")
def crosstab_status(spark, folder):
    return reshape.crosstab(
        table(spark, folder, "orders"),
        ["o_orderpriority"],
        "o_orderstatus",
        F.round(F.sum("o_totalprice"), 2),
        ["F", "O", "P"],
    )


@query("""
    SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '1-URGENT' GROUP BY 1
""")
def custom_sql(spark, folder):
    return custom_query(
        spark,
        "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > :low AND o_orderpriority = :prio GROUP BY 1",
        {"low": 300000, "prio": "1-URGENT"},
        orders=table(spark, folder, "orders"),
    )


@query("""
    SELECT p_name AS Part_Name, p_brand AS Part_Name_2, max(p_size) AS Max_Size FROM part GROUP BY ALL
""")
def safe_column_names(spark, folder):
    view = worksheet(table(spark, folder, "part"), ["p_name", "p_brand"], {"m": F.max("p_size")})
    return safe_names(view.toDF("Part Name", "(Part) Name", "Max  Size!"))


@query("""
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
""")
def csv_round_trip(spark, folder):
    supplier = table(spark, folder, "supplier")
    path = f"{shared_folder(spark)}/export/{uuid.uuid4().hex}"
    export_csv(supplier, path)
    return read_files(spark, path, "csv", schema=supplier.schema)


@query("""
    SELECT p_type, brand_place, p_brand, count(*) AS n FROM (
      SELECT *, rank() OVER (PARTITION BY p_type ORDER BY brand_n DESC, p_brand) AS brand_place FROM (
        SELECT p_type, p_brand, count(*) AS brand_n FROM part GROUP BY ALL)) JOIN part USING (p_type, p_brand)
    WHERE brand_place <= 2 GROUP BY ALL
""")
def top_in_group(spark, folder):
    from viewgrain.operators import tablecalc as tc
    from viewgrain.plans.keys import null_safe_join

    part = table(spark, folder, "part")
    view = worksheet(part, ["p_type", "p_brand"], {"brand_n": F.count(F.lit(1))})
    ranked = tc.rank(view, "brand_n", "brand_place", "unique", ["p_type"], tie_break=["p_brand"])
    best = ranked.where("brand_place <= 2").drop("brand_n")
    rows = null_safe_join(part, best, ["p_type", "p_brand"], "inner")
    return worksheet(rows, ["p_type", "brand_place", "p_brand"], {"n": F.count(F.lit(1))})


@query("""
    SELECT p_type, CAST(type_rank AS INTEGER) AS type_rank, count(*) AS n FROM part JOIN (
      SELECT p_type AS t, dense_rank() OVER (ORDER BY round(sum(p_retailprice), 2) DESC) AS type_rank FROM part GROUP BY 1) ON p_type = t
    WHERE type_rank <= 3 GROUP BY ALL
""")
def rank_filter(spark, folder):
    ranked = join_rank_back(table(spark, folder, "part"), "p_type", F.round(F.sum("p_retailprice"), 2), "type_rank")
    return worksheet(ranked, ["p_type", "type_rank"], {"n": F.count(F.lit(1))}, [F.col("type_rank") <= 3])


@query("""
    WITH a AS (SELECT o_orderpriority, CAST(sum(o_totalprice) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
         g AS (SELECT n_name, CAST(sum(c_acctbal) AS DOUBLE) AS balance, CAST(count(*) AS DOUBLE) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
         t AS (SELECT * FROM g ORDER BY balance + n DESC, n_name LIMIT 15)
    SELECT 'pivot' AS layout, o_orderpriority AS member, 'Total Price' AS Metric, round(total, 2) AS Value FROM a UNION ALL SELECT 'pivot', o_orderpriority, 'N', n FROM a
    UNION ALL SELECT 'geo_bar', n_name, 'Balance', round(balance, 2) FROM t UNION ALL SELECT 'geo_bar', n_name, 'N', n FROM t
""")
def measure_layouts(spark, folder):
    """Measure names on a shelf become a pivot, a map of two measures bars over its other dimension."""
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    pivot = reshape.measures_view(
        orders, "bar", ["o_orderpriority"], {"Total_Price": F.sum("o_totalprice"), "N": F.count(F.lit(1))}, measure_names=True
    )
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    bars = reshape.measures_view(
        people, "map", ["n_name", "c_nationkey"], {"Balance": F.sum("c_acctbal"), "N": F.count(F.lit(1))}, geo=["c_nationkey"]
    )
    parts = [pivot.select(F.lit("pivot").alias("layout"), F.col("o_orderpriority").alias("member"), "Metric", F.round("Value", 2).alias("Value"))]
    parts.append(bars.select(F.lit("geo_bar").alias("layout"), F.col("n_name").alias("member"), "Metric", F.round("Value", 2).alias("Value")))
    return parts[0].union(parts[1])
