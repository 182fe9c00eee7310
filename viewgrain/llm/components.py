"""Connected components of a graph whose edges Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewgrain.plans.settle import settle


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is its smallest node.

    Alternating stars: each round links every node's larger neighbours to the smallest
    neighbour (large star), then its smaller neighbours and itself to it (small star), until
    all edges point at the smallest node of their component. Rounds grow with the logarithm
    of the size of a component, not with its diameter. The smallest neighbour is an
    aggregate, so no neighbourhood is gathered; each round is a settled table, so a lost
    executor costs one round. Nodes without an edge are not in the result.
    """
    current = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _signature(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Settled before the join, so that adaptive execution can split a hub's edges.
        smallest = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settle(
            both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        lowest = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = settle(moved.unionByName(lowest.withColumnRenamed("m", "b")).distinct())
        now = _signature(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
