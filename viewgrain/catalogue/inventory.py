"""Jobs over metadata tables; the metadata is derived from the given tables, row by row."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewgrain import sources
from viewgrain.catalogue import query, table
from viewgrain.metadata import fields, formulas, graph, inventory, keys, names
from viewgrain.operators.view import worksheet
from viewgrain.plans.settle import shared_folder


def row_count():
    return F.count(F.lit(1))


def item_names(key):
    """Table and key column of a part: some tables have plural names, some keys are no id."""
    plural = F.when(F.col(key) % 3 == 1, "s").otherwise("")
    return F.concat(F.lit("item"), key, plural), F.when(F.col(key) % 2 == 0, "id").otherwise("serial")


def catalog(spark, folder):
    """One table per part, supplier, nation and customer, with reference columns between them."""
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    item_table, item_key = item_names("p_partkey")
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = [
        part.select(item_table.alias("table_name"), item_key.alias("column_name"), F.lit(True).alias("is_pk"), F.lit(1).alias("position")),
        supplier.select(F.concat(F.lit("Vendor"), "s_suppkey"), F.lit("vendor_no"), F.lit(True), F.lit(1)),
        pairs.select(
            F.concat(F.lit("Vendor"), "l_suppkey"), F.concat(F.lit("Item"), "l_partkey", F.lit("_ID")), F.lit(False), F.lit(2)
        ),
        table(spark, folder, "nation").select(
            F.concat(F.lit("area"), "n_nationkey"), F.concat(F.lit("area"), "n_nationkey", F.lit("_code")), F.lit(True), F.lit(1)
        ),
        table(spark, folder, "customer").select(
            F.concat(F.lit("client"), "c_custkey"), F.concat(F.lit("area"), "c_nationkey", F.lit("_code")), F.lit(False), F.lit(1)
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_CATALOG = """
    c AS (
      SELECT 'item' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN 's' ELSE '' END AS table_name,
             CASE WHEN p_partkey % 2 = 0 THEN 'id' ELSE 'serial' END AS column_name, TRUE AS is_pk, 1 AS position FROM part
      UNION ALL SELECT 'Vendor' || s_suppkey, 'vendor_no', TRUE, 1 FROM supplier
      UNION ALL SELECT DISTINCT 'Vendor' || l_suppkey, 'Item' || l_partkey || '_ID', FALSE, 2 FROM lineitem
      UNION ALL SELECT 'area' || n_nationkey, 'area' || n_nationkey || '_code', TRUE, 1 FROM nation
      UNION ALL SELECT 'client' || c_custkey, 'area' || c_nationkey || '_code', FALSE, 1 FROM customer)
"""


@query("WITH " + _CATALOG + """
    , t AS (SELECT table_name, min(column_name) AS pk, count(*) FILTER (WHERE lower(column_name) = 'id') AS has_id FROM c WHERE is_pk GROUP BY 1),
    r AS (SELECT table_name AS f, column_name AS fc, left(lower(column_name), length(column_name) - 3) AS ref FROM c WHERE lower(column_name) LIKE '%\\_id' ESCAPE '\\'),
    n AS (SELECT f, fc, coalesce(a.table_name, b.table_name) AS tt, coalesce(a.pk, b.pk) AS tc FROM r
          LEFT JOIN t a ON lower(a.table_name) = ref LEFT JOIN t b ON lower(b.table_name) = ref || 's' WHERE coalesce(a.table_name, b.table_name) IS NOT NULL),
    j AS (SELECT DISTINCT 'Vendor' || l_suppkey AS f, 'Item' || l_partkey || '_ID' AS fc, 'item' || l_partkey || CASE WHEN l_partkey % 3 = 1 THEN 's' ELSE '' END AS tt,
          CASE WHEN l_partkey % 2 = 0 THEN 'id' ELSE 'serial' END AS tc FROM lineitem),
    k AS (SELECT a.table_name AS f, a.column_name AS fc, b.table_name AS tt, b.column_name AS tc FROM c a JOIN c b
          ON lower(a.column_name) = lower(b.column_name) AND b.is_pk AND NOT a.is_pk AND a.table_name <> b.table_name AND lower(a.column_name) NOT LIKE '%\\_id' ESCAPE '\\'),
    u AS (SELECT *, 'table_id' AS kind, 0.6::DOUBLE AS confidence FROM n UNION ALL SELECT *, 'join', 0.9 FROM j UNION ALL SELECT *, 'same_key', 0.7 FROM k)
    SELECT f AS from_table, fc AS from_column, tt AS to_table, tc AS to_column, arg_max(kind, confidence) AS kind, max(confidence) AS confidence
    FROM u GROUP BY ALL
""")
def infer_keys(spark, folder):
    lines = table(spark, folder, "lineitem")
    item_table, item_key = item_names("l_partkey")
    joins = lines.select(
        F.concat(F.lit("Vendor"), "l_suppkey").alias("from_table"),
        F.concat(F.lit("Item"), "l_partkey", F.lit("_ID")).alias("from_column"),
        item_table.alias("to_table"),
        item_key.alias("to_column"),
    ).distinct()
    return keys.infer_keys(catalog(spark, folder), joins=joins)


@query("""
    WITH o AS (SELECT d.doc_id, l.doc_id AS parent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NOT NULL)
    SELECT count(*) AS child_rows, count(*) FILTER (WHERE parent IS NULL) AS orphan_rows,
      count(DISTINCT doc_id) FILTER (WHERE parent IS NULL) AS orphan_keys,
      (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_parent_keys,
      round(count(parent) / count(*), 8) AS inclusion FROM o
""")
def validate_key(spark, folder):
    out = keys.validate_key(table(spark, folder, "documents"), table(spark, folder, "labels"), {"doc_id": "doc_id"})
    return out.withColumn("inclusion", F.round("inclusion", 8))


@query("WITH " + _CATALOG + """
    SELECT 'ITEM' || p_partkey || '_id' AS physical_name, 'Vendor_No' || CASE WHEN p_size > 10 THEN 'x' ELSE '' END AS caption
    FROM part WHERE lower('ITEM' || p_partkey || '_id') NOT IN (SELECT lower(column_name) FROM c)
      AND lower('Vendor_No' || CASE WHEN p_size > 10 THEN 'x' ELSE '' END) NOT IN (SELECT lower(column_name) FROM c)
    UNION ALL
    SELECT 'unused' || c_custkey, c_name FROM customer
""")
def schema_mismatches(spark, folder):
    part = table(spark, folder, "part").select(
        F.concat(F.lit("ITEM"), "p_partkey", F.lit("_id")).alias("physical_name"),
        F.concat(F.lit("Vendor_No"), F.when(F.col("p_size") > 10, "x").otherwise("")).alias("caption"),
    )
    other = table(spark, folder, "customer").select(F.concat(F.lit("unused"), "c_custkey"), "c_name")
    return keys.schema_mismatches(part.union(other), catalog(spark, folder))


@query("WITH " + _CATALOG + """
    SELECT DISTINCT CAST(NULL AS VARCHAR) AS catalog_name, CAST(NULL AS VARCHAR) AS schema_name, table_name FROM c
    WHERE contains(lower(table_name), 'dor1')
""")
def search_tables(spark, folder):
    none = F.lit(None).cast("string")
    columns = catalog(spark, folder).withColumns({"catalog_name": none, "schema_name": none})
    return sources.search_tables(columns, "DOR1")


@query("WITH " + _CATALOG + " SELECT table_name, column_name, is_pk, position FROM c WHERE lower(column_name) = 'area7_code'")
def find_column(spark, folder):
    return sources.find_column(catalog(spark, folder), "AREA7_Code")


@query()
def match_names(spark, folder):
    part = table(spark, folder, "part")
    left = part.select(F.concat(F.initcap("p_name"), F.lit(" "), "p_type", F.lit("$A1:Z100"))).distinct()
    right = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_brand"))).distinct()
    return names.match_names(left, right)


def formula_rows(spark, folder):
    key = F.col("p_partkey")
    name = F.col("p_name")
    kinds = [
        F.concat(F.lit("SUM(["), name, F.lit("])")),
        F.concat(F.lit("{FIXED [p_brand] : AVG(["), name, F.lit("])}")),
        F.concat(F.lit("RUNNING_SUM(SUM(["), name, F.lit("]))")),
        F.lit("IF [a (x)] > 1 THEN FINDNTH([p_name], 'e', 2) ELSE zn ([p_size]) END"),
        F.concat(F.lit("REGEXP_MATCH([p_name], 'x') AND ISNULL([calc"), F.floor(key / 2).cast("string"), F.lit("])")),
        F.concat(F.lit("[calc"), F.floor(key / 2).cast("string"), F.lit("] / [calc"), F.floor(key / 3).cast("string"), F.lit("]")),
    ]
    formula = F
    for i, text in enumerate(kinds[:-1]):
        formula = formula.when(key % 6 == i, text)
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("workbook"),
        F.concat(F.lit("calc"), "p_partkey").alias("field"),
        formula.otherwise(kinds[-1]).alias("formula"),
        F.col("p_type").alias("source"),
        F.col("p_brand").alias("table"),
        "p_name",
    )


_FORMULAS = """
    f AS (SELECT p_brand AS workbook, 'calc' || p_partkey AS field, p_type AS source, p_brand AS "table", p_name, CASE p_partkey % 6
      WHEN 0 THEN 'SUM([' || p_name || '])' WHEN 1 THEN '{FIXED [p_brand] : AVG([' || p_name || '])}'
      WHEN 2 THEN 'RUNNING_SUM(SUM([' || p_name || ']))' WHEN 3 THEN 'IF [a (x)] > 1 THEN FINDNTH([p_name], ''e'', 2) ELSE zn ([p_size]) END'
      WHEN 4 THEN 'REGEXP_MATCH([p_name], ''x'') AND ISNULL([calc' || (p_partkey // 2) || '])'
      ELSE '[calc' || (p_partkey // 2) || '] / [calc' || (p_partkey // 3) || ']' END AS formula FROM part)
"""
_TOKENS = r"""unnest(list_transform(regexp_extract_all(regexp_replace(formula, '\[[^\]]*\]', ' ', 'g'), '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), lambda x: upper(x)))"""


@query("WITH " + _FORMULAS + f"SELECT workbook, field, formula, {_TOKENS} AS function FROM f")
def formula_tokens(spark, folder):
    return formulas.formula_tokens(formula_rows(spark, folder).select("workbook", "field", "formula"))


@query("WITH " + _FORMULAS + r"SELECT field, unnest(list_distinct(regexp_extract_all(formula, '\[([^\]]+)\]', 1))) AS ref FROM f")
def formula_refs(spark, folder):
    return formulas.formula_refs(formula_rows(spark, folder).select("field", "formula")).select("field", "ref")


@query("WITH " + _FORMULAS + """
    SELECT field, CASE WHEN formula LIKE '{FIXED%' THEN 'LOD' WHEN formula LIKE 'RUNNING_SUM%' THEN 'TABLE_CALC' ELSE 'STANDARD' END AS kind FROM f
""")
def classify_formulas(spark, folder):
    rows = formula_rows(spark, folder)
    return rows.select("field", formulas.classify_formula("formula").alias("kind"))


@query("WITH " + _FORMULAS + f"""
    SELECT DISTINCT field, function FROM (SELECT field, {_TOKENS} AS function FROM f) WHERE function IN ('FINDNTH', 'REGEXP_MATCH', 'RUNNING_SUM')
""")
def function_coverage(spark, folder):
    rows = formula_rows(spark, folder).select("field", "formula")
    return formulas.function_coverage(rows).select("field", "function")


@query("WITH " + _FORMULAS + """
    , s AS (SELECT 'Order ' || l_orderkey AS worksheet, CASE WHEN l_linenumber % 2 = 0 THEN 'calc' || l_partkey ELSE p_name END AS field, 'Cust ' || o_custkey AS dashboard
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    e AS (
      SELECT 'DS::' || source AS src, 'TBL::' || source || '::' || "table" AS dst, 'source_table' AS edge_type FROM f
      UNION SELECT 'TBL::' || source || '::' || "table", 'COL::' || source || '::' || p_name, 'table_column' FROM f
      UNION SELECT 'TBL::' || source || '::' || "table", 'CF::' || source || '::' || field, 'table_calc' FROM f
      UNION SELECT 'CF::' || coalesce(o.source, m.source) || '::' || a.ref, 'CF::' || a.source || '::' || a.field, 'calc_calc' FROM
        (SELECT *, unnest(regexp_extract_all(formula, '\\[([^\\]]+)\\]', 1)) AS ref FROM f) a JOIN (SELECT field, max(source) AS source FROM f GROUP BY 1) m ON a.ref = m.field
        LEFT JOIN (SELECT DISTINCT source, field FROM f) o ON a.ref = o.field AND a.source = o.source WHERE coalesce(o.source, m.source) <> a.source OR a.ref <> a.field
      UNION SELECT 'CF::' || f.source || '::' || f.field, 'WS::' || worksheet, 'calc_worksheet' FROM s JOIN f ON s.field = f.field
      UNION SELECT 'COL::' || f.source || '::' || f.p_name, 'WS::' || worksheet, 'column_worksheet' FROM s JOIN (SELECT DISTINCT source, p_name FROM f) f ON s.field = f.p_name
      UNION SELECT 'WS::' || worksheet, 'DB::' || dashboard, 'worksheet_dashboard' FROM s)
    SELECT src, dst, edge_type FROM e
""")
def lineage_edges(spark, folder):
    calcs = formula_rows(spark, folder)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    orders = table(spark, folder, "orders")
    used = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    sheet = F.concat(F.lit("Order "), "l_orderkey")
    field = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("calc"), "l_partkey")).otherwise(F.col("p_name"))
    dashboards = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_semi").select(
        F.concat(F.lit("Cust "), "o_custkey").alias("dashboard"), F.concat(F.lit("Order "), "o_orderkey").alias("worksheet")
    )
    return graph.lineage_edges(
        tables=calcs.select("source", "table"),
        columns=calcs.select("source", "table", F.col("p_name").alias("column")),
        calcs=calcs.select("source", "table", F.col("field").alias("calc"), "formula"),
        worksheet_fields=used.select(sheet.alias("worksheet"), field.alias("field")),
        dashboard_sheets=dashboards,
    )


def trade_edges(spark, folder):
    """customer -> order -> part -> supplier."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")

    def named(prefix, column):
        return F.concat(F.lit(prefix), column)

    return graph.typed_edges(
        {
            "order": orders.select(named("C", "o_custkey").alias("src"), named("O", "o_orderkey").alias("dst")),
            "line": lines.select(named("O", "l_orderkey").alias("src"), named("P", "l_partkey").alias("dst")),
            "supply": lines.select(named("P", "l_partkey").alias("src"), named("S", "l_suppkey").alias("dst")),
        }
    )


@query("""
    WITH r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9900),
    o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM r)),
    p AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_orderkey IN (SELECT k FROM o)),
    s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_partkey IN (SELECT k FROM p))
    SELECT 'C' || k AS node, 0 AS depth FROM r UNION ALL SELECT 'O' || k, 1 FROM o UNION ALL SELECT 'P' || k, 2 FROM p UNION ALL SELECT 'S' || k, 3 FROM s
""")
def impact(spark, folder):
    roots = table(spark, folder, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("C"), "c_custkey"))
    return graph.impact(trade_edges(spark, folder), roots)


def part_tree(spark, folder):
    """Each part hangs on the part with half its number."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").where(key > 0).select(
        F.floor(key / 2).alias("src"), key.alias("dst"), F.lit("half").alias("edge_type")
    )


@query("""
    WITH RECURSIVE a AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 50
      UNION SELECT node // 2, depth + 1 FROM a WHERE node > 0)
    SELECT node, min(depth) AS depth FROM a GROUP BY 1
""")
def lineage(spark, folder):
    targets = table(spark, folder, "part").where("p_size = 50").select("p_partkey")
    return graph.lineage(part_tree(spark, folder), targets)


@query("SELECT CAST(0 AS BIGINT) AS node, min(depth) AS depth FROM (SELECT length(bin(p_partkey)) AS depth FROM part WHERE p_size = 50 AND p_partkey > 0)")
def lineage_bases(spark, folder):
    targets = table(spark, folder, "part").where("p_size = 50").select("p_partkey")
    out = graph.lineage_bases(part_tree(spark, folder), targets)
    return out.withColumn("depth", F.col("depth").cast("bigint"))


@query("SELECT p_partkey AS node, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) END AS INTEGER) AS level FROM part")
def topo_levels(spark, folder):
    key = F.col("p_partkey")
    third = table(spark, folder, "part").where(key > 0).select(
        F.floor(key / 3).alias("src"), key.alias("dst"), F.lit("third").alias("edge_type")
    )
    return graph.topo_levels(part_tree(spark, folder).union(third))


@query("""
    WITH RECURSIVE a AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 AND p_partkey > 0 UNION SELECT node // 2 FROM a WHERE node > 0)
    SELECT DISTINCT node FROM a
""")
def cycles(spark, folder):
    back = table(spark, folder, "part").where("p_size = 1 AND p_partkey > 0").select(
        F.col("p_partkey").alias("src"), F.lit(0).cast("bigint").alias("dst"), F.lit("back").alias("edge_type")
    )
    return graph.cycles(part_tree(spark, folder).union(back))


@query("""
    WITH p AS (SELECT p_partkey, p_brand, min(p_partkey) OVER w AS low, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand))
    SELECT p_partkey AS node, low AS cycle FROM p WHERE n > 1 OR p_partkey % 97 = 0
    UNION ALL SELECT -1 - n_nationkey, -1 - n_nationkey FROM nation WHERE n_nationkey % 3 = 0
""")
def cycle_groups(spark, folder):
    """The parts of a brand in a ring, a bridge from one ring to another, and nations that point
    at themselves."""
    part = table(spark, folder, "part")
    ring = W.partitionBy("p_brand").orderBy("p_partkey")
    low = F.min("p_partkey").over(W.partitionBy("p_brand"))
    rings = part.select(F.col("p_partkey").alias("src"), F.coalesce(F.lead("p_partkey").over(ring), low).alias("dst"))
    rings = rings.where("src <> dst OR src % 97 = 0")
    lows = part.groupBy("p_brand").agg(F.min("p_partkey").alias("low"))
    ends = lows.agg(F.min("low").alias("low"), F.max("low").alias("next"))
    bridge = F.col("low") + 10**12
    bridges = ends.select(F.col("low").alias("src"), bridge.alias("dst")).union(ends.select(bridge, F.col("next")))
    nation = table(spark, folder, "nation").where("n_nationkey % 3 = 0").select((-1 - F.col("n_nationkey")).cast("long").alias("src"))
    selves = nation.select("src", F.col("src").alias("dst"))
    edges = reduce(DataFrame.union, [rings, bridges, selves])
    return graph.cycle_groups(edges)


@query("""
    SELECT p_partkey AS node, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS level FROM part
    UNION ALL SELECT -1 - s_suppkey, 0 FROM supplier
""")
def chain_levels(spark, folder):
    """All parts in one chain, and suppliers that no edge names."""
    part = table(spark, folder, "part")
    chain = part.select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(W.orderBy("p_partkey")).alias("dst"))
    nodes = part.select("p_partkey").union(table(spark, folder, "supplier").select(-1 - F.col("s_suppkey")))
    return graph.topo_levels(chain.where("dst IS NOT NULL"), nodes)


@query("SELECT p_partkey AS node, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS depth FROM part")
def chain_impact(spark, folder):
    part = table(spark, folder, "part")
    chain = part.select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(W.orderBy("p_partkey")).alias("dst"))
    return graph.impact(chain.where("dst IS NOT NULL"), part.agg(F.min("p_partkey").alias("p_partkey")))


@query("""
    WITH a AS (SELECT * FROM customer WHERE c_custkey % 7 > 0), b AS (SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal) FROM customer WHERE c_custkey % 11 > 0)
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal <> b.c_acctbal
""")
def stored_snapshots(spark, folder):
    """Two stored snapshots, of which only the key buckets that differ are read again."""
    customer = table(spark, folder, "customer")
    balance = F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal"))
    kept = {"old": customer.where("c_custkey % 7 > 0"), "new": customer.where("c_custkey % 11 > 0").withColumn("c_acctbal", balance)}
    at = f"{shared_folder(spark)}/viewgrain/snapshots-{uuid.uuid4().hex}"
    for name, rows in kept.items():
        inventory.store_snapshot(rows, ["c_custkey"], f"{at}/{name}", 16)
    return inventory.stored_diff(spark, f"{at}/old", f"{at}/new", ["c_custkey"])


@query(r"""
    WITH c AS (SELECT DISTINCT p_name || ' ' || p_type || '$A1:Z100' AS l, lower(p_name || ' ' || p_type) AS c FROM part),
         d AS (SELECT DISTINCT upper(p_name) || '/' || p_type AS r, lower(p_name || ' ' || p_type) AS c FROM part),
         k AS (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY r) AS k FROM c JOIN d USING (c))
    SELECT l AS left_name, r AS right_name, CAST(1.0 AS DOUBLE) AS score, 'strong' AS label FROM k WHERE k <= 5
""")
def match_names_exact(spark, folder):
    """Names that are the same once cleaned: a confidence of one."""
    part = table(spark, folder, "part")
    left = part.select(F.concat("p_name", F.lit(" "), "p_type", F.lit("$A1:Z100")))
    right = part.select(F.concat(F.upper("p_name"), F.lit("/"), "p_type"))
    return names.match_names(left, right, min_conf=1.0)


@query("""
    SELECT 'P' || p_partkey AS id, 'column' AS type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT 'D' || doc_id, 'column' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'C' || c_custkey, 'calculated_field' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def orphans(spark, folder):
    kinds = {
        "column": [("part", "P", "p_partkey"), ("documents", "D", "doc_id")],
        "calculated_field": [("customer", "C", "c_custkey")],
        "table": [("supplier", "S", "s_suppkey")],
    }
    used = [("lineitem", "P", "l_partkey"), ("orders", "C", "o_custkey"), ("labels", "D", "doc_id")]

    def named(source, prefix, key):
        return table(spark, folder, source).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"))

    nodes = [named(*n).withColumn("type", F.lit(kind)) for kind, of in kinds.items() for n in of]
    edges = [named(*n).withColumnRenamed("id", "src") for n in used]
    return graph.orphans(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def datasets_and_widgets(spark, folder):
    text = (
        F.when(F.col("event_type") == "click", "")
        .when(F.col("event_type") == "view", "SELECT :Measure Names FROM t")
        .when(F.col("event_type") == "error", "SELECT a FROM `Sheet1$` ")
        .when(F.col("event_type") == "signup", "SELECT [excel-direct.0x1] FROM x")
        .otherwise(F.concat(F.lit("SELECT "), "user_id"))
    )
    datasets = table(spark, folder, "events").select(
        F.concat(F.lit("ds"), (F.col("event_id") - F.col("event_id") % 4 % 3).cast("string")).alias("dataset"), text.alias("query")
    )
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "bar").when(F.col("o_orderstatus") == "O", "pivot").otherwise("sankey")
    widgets = table(spark, folder, "orders").select(
        F.concat(F.lit("w"), key.cast("string")).alias("widget"),
        F.concat(F.lit("ds"), F.col("o_custkey").cast("string")).alias("dataset"),
        kind.alias("type"),
        (F.col("o_custkey") % 8 - 1).cast("int").alias("x"),
        (key % 8).cast("int").alias("width"),
        (key % 3).cast("int").alias("height"),
    )
    return datasets, widgets


_DATASETS = """
    d AS (SELECT 'ds' || (event_id - event_id % 4 % 3) AS dataset, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'SELECT :Measure Names FROM t'
      WHEN 'error' THEN 'SELECT a FROM `Sheet1$` ' WHEN 'signup' THEN 'SELECT [excel-direct.0x1] FROM x' ELSE 'SELECT ' || user_id END AS query FROM events),
    w AS (SELECT 'w' || o_orderkey AS widget, 'ds' || o_custkey AS dataset, CASE o_orderstatus WHEN 'F' THEN 'bar' WHEN 'O' THEN 'pivot' ELSE 'sankey' END AS type,
      CAST(o_custkey % 8 - 1 AS INTEGER) AS x, CAST(o_orderkey % 8 AS INTEGER) AS width, CAST(o_orderkey % 3 AS INTEGER) AS height FROM orders)
"""


_BROKEN = """
    SELECT 'empty_query' AS rule, 'ERROR' AS severity, dataset AS key, 'query is empty' AS message FROM d WHERE query = ''
    UNION ALL SELECT 'pseudo_field', 'ERROR', dataset, 'query uses a pseudo-field' FROM d WHERE query LIKE '%Measure Names%'
    UNION ALL SELECT 'internal_id', 'ERROR', dataset, 'query uses an internal id' FROM d WHERE query LIKE '%excel-direct.%'
    UNION ALL SELECT 'unresolved_table', 'ERROR', dataset, 'table is not mapped' FROM d WHERE query LIKE '%FROM `Sheet1$`%'
    UNION ALL SELECT 'reference', 'ERROR', widget, 'dataset does not exist' FROM w WHERE dataset NOT IN (SELECT dataset FROM d)
    UNION ALL SELECT 'bounds_x', 'ERROR', widget, 'x is outside the grid' FROM w WHERE x NOT BETWEEN 0 AND 5
    UNION ALL SELECT 'bounds_width', 'ERROR', widget, 'width is outside the grid' FROM w WHERE width NOT BETWEEN 1 AND 6
    UNION ALL SELECT 'bounds_right', 'ERROR', widget, 'widget passes the right edge' FROM w WHERE x + width > 6
    UNION ALL SELECT 'bounds_height', 'ERROR', widget, 'height is below 1' FROM w WHERE height < 1
    UNION ALL SELECT 'widget_type', 'WARNING', widget, 'chart type is not supported' FROM w WHERE type = 'sankey'
    UNION ALL SELECT 'duplicate_dataset', 'ERROR', dataset, 'dataset name is used twice' FROM d GROUP BY dataset HAVING count(*) > 1
    UNION ALL SELECT 'duplicate_widget', 'ERROR', widget, 'widget id is used twice' FROM w GROUP BY widget HAVING count(*) > 1
"""


@query("WITH " + _DATASETS + _BROKEN)
def check_rules(spark, folder):
    return inventory.check_rules(*datasets_and_widgets(spark, folder))


@query("WITH " + _DATASETS + """
    , m AS (SELECT query, min('u' || o_orderkey) AS kept FROM (SELECT o_orderkey, 'SELECT * FROM t WHERE c = ' || o_custkey AS query FROM orders) GROUP BY 1)
    SELECT DISTINCT 'w' || l_linenumber || CASE WHEN l_returnflag = 'A' THEN '' ELSE '_' || l_partkey END AS widget, kept AS dataset
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN m ON m.query = 'SELECT * FROM t WHERE c = ' || o_custkey
""")
def dedupe_queries(spark, folder):
    datasets = table(spark, folder, "orders").select(
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("dataset"),
        F.concat(F.lit("SELECT * FROM t WHERE c = "), F.col("o_custkey").cast("string")).alias("query"),
    )
    tail = F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("_"), F.col("l_partkey").cast("string")))
    widgets = table(spark, folder, "lineitem").select(
        F.concat(F.lit("w"), F.col("l_linenumber").cast("string"), tail).alias("widget"),
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("dataset"),
    )
    _, pointed = inventory.dedupe_queries(datasets, widgets)
    return pointed


@query("""
    WITH s AS (SELECT l_orderkey AS worksheet, count(*) AS field_count, count(*) FILTER (WHERE l_returnflag = 'A') AS calc_count,
      count(*) FILTER (WHERE l_discount >= 0.1) AS lod_count, count(*) FILTER (WHERE l_tax >= 0.08) AS table_calc_count,
      count(*) FILTER (WHERE l_quantity > 40) AS filter_count, CASE WHEN max(l_linenumber) = 7 THEN 'Filled Map' ELSE 'Bar' END AS visual_type,
      min(l_quantity) < 3 AS has_pages FROM lineitem GROUP BY 1),
    r AS (SELECT *, least(2 * field_count, 20) + 5 * calc_count + 15 * lod_count + 12 * table_calc_count + 2 * filter_count
      + CASE WHEN visual_type = 'Filled Map' THEN 20 ELSE 0 END + CASE WHEN has_pages THEN 10 ELSE 0 END AS raw FROM s)
    SELECT worksheet, CAST(least(raw, 100) AS BIGINT) AS score,
      CASE WHEN raw <= 15 THEN 'Simple' WHEN raw <= 35 THEN 'Medium' WHEN raw <= 65 THEN 'Complex' ELSE 'Very Complex' END AS label FROM r
""")
def complexity(spark, folder):
    sheets = worksheet(
        table(spark, folder, "lineitem"),
        [("worksheet", F.col("l_orderkey"))],
        {
            "field_count": row_count(),
            "calc_count": F.count_if(F.col("l_returnflag") == "A"),
            "lod_count": F.count_if(F.col("l_discount") >= 0.1),
            "table_calc_count": F.count_if(F.col("l_tax") >= 0.08),
            "filter_count": F.count_if(F.col("l_quantity") > 40),
            "visual_type": F.when(F.max("l_linenumber") == 7, "Filled Map").otherwise("Bar"),
            "has_pages": F.min("l_quantity") < 3,
        },
    )
    return inventory.complexity(sheets).select("worksheet", "score", "label")


@query("WITH " + _FORMULAS + """
    , e AS (SELECT workbook, count(*) AS expressions, count(*) FILTER (WHERE formula LIKE '{FIXED%') AS lod,
      count(*) FILTER (WHERE formula LIKE 'RUNNING_SUM%') AS table_calc FROM f GROUP BY 1),
    s AS (SELECT p_brand AS workbook, count(*) AS worksheets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    q AS (SELECT p_brand AS workbook, count(*) AS parameters FROM part GROUP BY 1)
    SELECT workbook, coalesce(worksheets, 0) AS worksheets, coalesce(expressions, 0) AS expressions, coalesce(expressions - lod - table_calc, 0) AS standard,
      coalesce(lod, 0) AS lod, coalesce(table_calc, 0) AS table_calc, coalesce(parameters, 0) AS parameters
    FROM e FULL JOIN s USING (workbook) FULL JOIN q USING (workbook)
""")
def migration_summary(spark, folder):
    part, lines = table(spark, folder, "part"), table(spark, folder, "lineitem")
    sheets = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("workbook"))
    parameters = part.select(F.col("p_brand").alias("workbook"))
    return inventory.migration_summary(sheets, formula_rows(spark, folder), parameters)


@query("""
    WITH a AS (SELECT * FROM orders WHERE o_orderdate < DATE '2001-01-01'),
    b AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderdate >= DATE '1996-01-01')
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice
""")
def snapshot_diff(spark, folder):
    orders = table(spark, folder, "orders")
    old = orders.where(F.col("o_orderdate") < F.lit(dt.date(2001, 1, 1)))
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = orders.where(F.col("o_orderdate") >= F.lit(dt.date(1996, 1, 1))).withColumn("o_totalprice", price)
    return inventory.snapshot_diff(old, new, ["o_orderkey"])


@query("""
    WITH b AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders)
    SELECT 'row count' AS item, (SELECT count(*) FROM orders) = (SELECT count(*) FROM b) AS equal
    UNION ALL SELECT 'row', (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM b)) = 0
    UNION ALL SELECT 'column o_orderkey', (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT o_orderkey FROM b)) = 0
    UNION ALL SELECT 'column o_custkey', (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM b)) = 0
    UNION ALL SELECT 'column o_orderstatus', (SELECT count(*) FROM (SELECT o_orderstatus FROM orders EXCEPT ALL SELECT o_orderstatus FROM b)) = 0
    UNION ALL SELECT 'column o_totalprice', (SELECT count(*) FROM (SELECT o_totalprice FROM orders EXCEPT ALL SELECT o_totalprice FROM b)) = 0
    UNION ALL SELECT 'column o_orderdate', (SELECT count(*) FROM (SELECT o_orderdate FROM orders EXCEPT ALL SELECT o_orderdate FROM b)) = 0
    UNION ALL SELECT 'column o_orderpriority', (SELECT count(*) FROM (SELECT o_orderpriority FROM orders EXCEPT ALL SELECT o_orderpriority FROM b)) = 0
""")
def reconcile(spark, folder):
    orders = table(spark, folder, "orders")
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return inventory.reconcile(orders, orders.withColumn("o_totalprice", price)).select("item", "equal")


@query("""
    SELECT field, semantic, aggregation, count(*) AS n FROM (
      SELECT CASE p_size % 12 WHEN 0 THEN p_type || ' ID' WHEN 1 THEN p_type || '_rate' WHEN 2 THEN 'avg_' || p_type WHEN 3 THEN 'Total ' || p_type
          WHEN 4 THEN p_type || ' month' WHEN 5 THEN p_type || '_name' WHEN 6 THEN p_type || ' segment' WHEN 7 THEN 'when' WHEN 8 THEN 'flag'
          WHEN 9 THEN 'amount' WHEN 10 THEN 'customer_key' ELSE 'cost' END AS field,
        CASE p_size % 12 WHEN 0 THEN 'IDENTIFIER' WHEN 1 THEN 'RATIO' WHEN 2 THEN 'AVERAGE' WHEN 3 THEN 'PRE_AGGREGATED' WHEN 4 THEN 'DATE'
          WHEN 5 THEN 'DIMENSION' WHEN 6 THEN 'DIMENSION' WHEN 7 THEN 'DATE' WHEN 8 THEN 'BOOLEAN' WHEN 9 THEN 'ADDITIVE' WHEN 10 THEN 'COUNT' ELSE 'AVERAGE' END AS semantic,
        CASE p_size % 12 WHEN 1 THEN 'AVG' WHEN 2 THEN 'AVG' WHEN 3 THEN 'SUM' WHEN 9 THEN 'MAX' WHEN 10 THEN 'COUNT' WHEN 11 THEN 'AVG' ELSE 'NONE' END AS aggregation
      FROM part) GROUP BY ALL
""")
def auto_aggregation(spark, folder):
    kind = F.col("p_type")
    choices = [
        (F.concat(kind, F.lit(" ID")), "integer", "measure", None),
        (F.concat(kind, F.lit("_rate")), "real", "measure", "Sum"),
        (F.concat(F.lit("avg_"), kind), "real", "measure", "Sum"),
        (F.concat(F.lit("Total "), kind), "real", "measure", None),
        (F.concat(kind, F.lit(" month")), "string", "dimension", None),
        (F.concat(kind, F.lit("_name")), "string", "dimension", None),
        (F.concat(kind, F.lit(" segment")), "string", "dimension", None),
        (F.lit("when"), "datetime", "dimension", None),
        (F.lit("flag"), "boolean", "dimension", None),
        (F.lit("amount"), "real", "measure", "Max"),
        (F.lit("customer_key"), "integer", "measure", "CountD"),
        (F.lit("cost"), "real", "measure", "Avg"),
    ]

    def pick(i):
        out = F
        for n, choice in enumerate(choices):
            value = choice[i]
            out = out.when(F.col("p_size") % 12 == n, F.lit(value) if not i == 0 else value)
        return out

    inventory_fields = table(spark, folder, "part").select(
        pick(0).alias("field"), pick(1).alias("datatype"), pick(2).alias("role"), pick(3).alias("default_aggregation")
    )
    return worksheet(
        fields.auto_aggregation(inventory_fields), ["field", "semantic", "aggregation"], {"n": row_count()}
    )


@query("WITH " + _DATASETS + f"SELECT severity, rule, count(*) AS n FROM ({_BROKEN}) GROUP BY ALL")
def rule_summary(spark, folder):
    return inventory.rule_summary(inventory.check_rules(*datasets_and_widgets(spark, folder)))


@query("""
    SELECT min('u' || o_orderkey) AS dataset, 'SELECT * FROM t WHERE c = ' || o_custkey AS query FROM orders GROUP BY 2
""")
def dedupe_kept(spark, folder):
    datasets = table(spark, folder, "orders").select(
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("dataset"),
        F.concat(F.lit("SELECT * FROM t WHERE c = "), F.col("o_custkey").cast("string")).alias("query"),
    )
    kept, _ = inventory.dedupe_queries(datasets, datasets.select(F.col("dataset").alias("widget"), "dataset"))
    return kept


@query("""
    WITH a AS (SELECT * FROM customer WHERE c_acctbal > 0), b AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT 'added' AS change, count(*) AS n FROM b WHERE c_acctbal <= 0
    UNION ALL SELECT 'removed', count(*) FROM a WHERE c_mktsegment = 'BUILDING'
""")
def reconcile_keys(spark, folder):
    customer = table(spark, folder, "customer")
    return inventory.reconcile_keys(
        customer.where("c_acctbal > 0"), customer.where("c_mktsegment <> 'BUILDING'"), ["c_custkey"]
    )


@query("WITH " + _CATALOG + """
    SELECT table_name, CAST(count(*) AS BIGINT) AS columns, count(*) FILTER (WHERE is_pk) AS keys FROM c GROUP BY 1
""")
def catalog_summary(spark, folder):
    return worksheet(
        catalog(spark, folder), ["table_name"], {"columns": row_count(), "keys": F.count_if(F.col("is_pk"))}
    )
