"""Lineage edges and closures over them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewgrain.metadata import depths
from viewgrain.metadata.formulas import formula_refs
from viewgrain.plans.keys import null_safe_join
from viewgrain.plans.ordered import MOST_BLOCKS
from viewgrain.plans.settle import block_rows, settle

EDGE_COLUMNS = ["src", "dst", "edge_type"]


def node_id(prefix: str, *parts: str):
    """``PREFIX::a::b`` from column names; NULL if a part is."""
    return F.concat(F.lit(prefix), *[piece for p in parts for piece in (F.lit("::"), F.col(p))])


def lineage_edges(
    tables: DataFrame,
    columns: DataFrame,
    calcs: DataFrame,
    worksheet_fields: DataFrame,
    dashboard_sheets: DataFrame,
) -> DataFrame:
    """Edges source -> table -> column -> calculation -> worksheet -> dashboard.

    tables(source, table); columns(source, table, column); calcs(source, table, calc,
    formula) with the table optional per row; worksheet_fields(worksheet, field);
    dashboard_sheets(dashboard, worksheet). A calculation depends on its tables and on
    the calculations it names in brackets: on that of its own source, or where that has none
    of the name on the last source's, by name, that does. A worksheet takes a calculation
    before a column of the same name, source by source.
    """
    # Each of these is read by several kinds of edges.
    calcs = settle(calcs.select("source", "table", "calc", "formula"))
    columns = settle(columns.select("source", "table", "column").distinct())
    fields = settle(worksheet_fields.select("worksheet", "field").distinct())
    table = node_id("TBL", "source", "table")
    calc = node_id("CF", "source", "calc")
    known = tables.select("source", "table").distinct()
    source_table = known.select(node_id("DS", "source").alias("src"), table.alias("dst"))
    table_column = columns.join(known, ["source", "table"], "left_semi").select(
        table.alias("src"), node_id("COL", "source", "column").alias("dst")
    )
    table_calc = calcs.join(known, ["source", "table"], "left_semi").select(
        table.alias("src"), calc.alias("dst")
    )
    calc_nodes = calcs.select("source", "calc").distinct()
    refs = formula_refs(calcs.select("source", "calc", "formula").distinct(), "formula").select("source", "calc", "ref")
    own = calc_nodes.select("source", F.col("calc").alias("ref"), F.lit(True).alias("own"))
    # One row per name: however many sources have it, a reference is resolved to one of them.
    elsewhere = calc_nodes.groupBy(F.col("calc").alias("ref")).agg(F.max("source").alias("other"))
    # Names grow with the rows: what is merged here is never sent through the driver.
    resolved = refs.join(own.hint("merge"), ["source", "ref"], "left").join(elsewhere.hint("merge"), "ref")
    named = resolved.select(
        F.when(F.col("own"), F.col("source")).otherwise(F.col("other")).alias("of"), "ref", calc.alias("dst")
    )
    calc_calc = named.select(node_id("CF", "of", "ref").alias("src"), "dst").where("src <> dst")
    sheet = node_id("WS", "worksheet")
    column_nodes = columns.select("source", F.col("column").alias("field")).distinct()
    calc_fields = calc_nodes.select("source", F.col("calc").alias("field"))
    column_only = settle(column_nodes.join(calc_fields.hint("merge"), ["source", "field"], "left_anti"))
    sheet_dashboard = dashboard_sheets.join(fields, "worksheet", "left_semi").select("worksheet", "dashboard").distinct()
    small = typed_edges({"source_table": source_table, "table_column": table_column, "table_calc": table_calc, "calc_calc": calc_calc})
    # As many as there are uses of fields: made without repeats instead of compared as text.
    large = {
        "column_worksheet": _uses(fields, column_only.select(node_id("COL", "source", "field").alias("src"), "field").distinct()),
        "calc_worksheet": _uses(fields, calc_fields.select(node_id("CF", "source", "field").alias("src"), "field").distinct().hint("merge")),
        "worksheet_dashboard": sheet_dashboard.select(sheet.alias("src"), node_id("DB", "dashboard").alias("dst")),
    }
    return reduce(DataFrame.unionByName, [small, *_typed(large)])


def _uses(fields: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges from nodes(src, field) to the worksheets of fields(worksheet, field), all distinct.

    Edges can only be alike if nodes of different fields have one id, as ``a::b`` of ``c`` and
    ``b::c`` in ``a`` do, or all without a source. These are set apart, the others not compared.
    """
    alike = settle(nodes.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src"))

    def used(of: DataFrame) -> DataFrame:
        return fields.join(of, "field").select("src", node_id("WS", "worksheet").alias("dst"))

    if alike.isEmpty():
        return used(nodes)
    once, again = (null_safe_join(nodes, alike, ["src"], how) for how in ("left_anti", "left_semi"))
    return used(once).unionByName(used(again).distinct())


def _typed(kinds: Mapping[str, DataFrame]) -> list[DataFrame]:
    return [df.select("src", "dst", F.lit(kind).alias("edge_type")) for kind, df in kinds.items()]


def typed_edges(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct (src, dst, edge_type) rows from one frame of (src, dst) per edge type."""
    return reduce(DataFrame.unionByName, _typed(kinds)).distinct()


#: Rounds a closure goes step by step before it contracts the chains that are left.
PLAIN_ROUNDS = 16


def impact(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node downstream of the roots with its least number of steps; roots are 0.

    Each round follows only the nodes first reached in the round before, so cycles end. What
    is still open after ``PLAIN_ROUNDS`` is contracted first (``depths.hang``), so a long
    chain takes rounds by the logarithm of its length.
    """
    links = settle(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = settle(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    rounds, depth = [frontier.withColumn("depth", F.lit(0))], 0
    reached = frontier
    while depth < PLAIN_ROUNDS:
        depth += 1
        step = links.join(frontier, links["src"] == frontier["node"], "left_semi")
        found = step.select(F.col("dst").alias("node")).distinct()
        frontier = settle(found.join(reached, "node", "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.union, rounds)
        rounds.append(frontier.withColumn("depth", F.lit(depth)))
        # Every few rounds the pieces are rewritten as one table to keep the plan short.
        reached = reached.union(frontier) if depth % 8 else settle(reached.union(frontier))
    closed = reached.join(frontier, "node", "left_anti").select(F.col("node").alias("src"))
    ahead = links.join(reached.select(F.col("node").alias("dst")), "dst", "left_anti").join(closed, "src", "left_anti")
    further = depths.nearest(ahead, frontier).where("depth > 0").select("node", (F.col("depth") + depth).cast("int").alias("depth"))
    return reduce(DataFrame.union, [*rounds, further])


def lineage(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Everything upstream of the targets, with the least number of steps."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return impact(turned, targets)


def lineage_bases(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The upstream nodes that nothing feeds."""
    fed = edges.select(F.col("dst").alias("node"))
    return lineage(edges, targets).join(fed, "node", "left_anti")


def topo_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level) by the longest path from a node nothing feeds.

    Nodes on a cycle, or fed by one, have no level and are left out. ``nodes`` (first column)
    may name more nodes than the edges do; those without an edge have level 0. Chains take
    rounds by the logarithm of their length, see ``depths.longest``.
    """
    found = depths.longest(edges).select("node", F.col("level").cast("int").alias("level"))
    if nodes is None:
        return found
    met = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    alone = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node IS NOT NULL").distinct().join(met.hint("merge"), "node", "left_anti")
    return found.unionByName(alone.withColumn("level", F.lit(0)))


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(node, cycle): the nodes on a cycle, with the smallest node that shares cycles with them.

    These are the strongly connected components of more than one node, and the nodes that
    point at themselves. Nodes between two cycles are on none and left out.
    """
    return depths.strong_components(edges)


def cycles(edges: DataFrame) -> DataFrame:
    """The nodes left when nodes without a way in or without a way out are peeled off:
    those on a cycle or on a path between two cycles."""
    left = settle(edges.select("src", "dst").distinct())
    count = left.count()
    while count:
        sources = left.select(F.col("src").alias("node"))
        targets = left.select(F.col("dst").alias("node"))
        kept = left.join(targets, left["src"] == targets["node"], "left_semi")
        kept = kept.join(sources, kept["dst"] == sources["node"], "left_semi")
        left = settle(kept)
        rest = left.count()
        if rest == count:
            break
        count = rest
    return left.select(F.col("src").alias("node")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("column", "calculated_field")) -> DataFrame:
    """Columns and calculations that nothing uses; ``nodes`` has the columns (id, type).

    Both sides are counted first and dealt by id into parts of about ``block_rows`` rows, however
    few bytes a shuffle packs them into; of a node that many edges name, one row is joined. An
    anti-join would be pushed into a union of nodes, and each of its parts join all edges again.
    """
    of_types = nodes.where(F.col("type").isin(*types))
    rows = of_types.count() + edges.count()
    parts = min(1 + rows // block_rows(nodes.sparkSession), MOST_BLOCKS)
    used = edges.select(F.col("src").alias("id")).repartition(parts, "id").distinct().withColumn("__used", F.lit(True))
    return of_types.repartition(parts, "id").join(used, "id", "left").where("__used IS NULL").drop("__used")
