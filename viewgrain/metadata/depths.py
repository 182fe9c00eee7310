"""Depths, levels and cycles of graphs that may be as deep as they are large.

A step per round is right for a shallow graph and hopeless for a chain. So nodes with a
single way in are hung on the nearest node above them that has none or several: pointers are
doubled, so a chain of any length takes rounds by its logarithm, and what is left to walk
are the nodes where ways meet.

The joins of these rounds are merged: a table packed into a few megabytes of Parquet would be
broadcast, unpacked, in round after round, and all of that goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewgrain.plans.settle import settle

#: Chains are contracted again while one node in so many hangs on another.
WORTHWHILE = 8
#: Rounds in which nodes are peeled off one layer at a time.
PEELED = 4


def _weighted(edges: DataFrame) -> DataFrame:
    return settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("w", F.lit(1).cast("long")))


def hang(links: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, up, dist, first) of nodes that hang on a node ``up``, and (node, least) of those on a loop.

    A node with one way in hangs on the next node above that has none or several, or is in
    ``keep``; dist adds up the weights in between, ``first`` is the topmost of the nodes in
    between, or the node itself. Where there is no such node, the ways up run into a loop;
    ``least`` is the smallest node found above, which for the nodes of the loop is the same.
    """
    ways = links.groupBy("dst").agg(F.count(F.lit(1)).alias("ways"), F.min("src").alias("up"), F.min("w").alias("dist"))
    single = ways.where("ways = 1").select(F.col("dst").alias("node"), "up", "dist")
    if keep is not None:
        single = single.join(keep.select("node"), "node", "left_anti")
    at = settle(single.withColumns({"least": F.least("node", "up"), "first": F.col("node"), "open": F.lit(True)}))
    n = at.count()
    for _ in range(n.bit_length() // 2 + 1 if n else 0):
        at = settle(_doubled(_doubled(at)))
        if at.where("open").isEmpty():
            break
    return at.where("NOT open").select("node", "up", "dist", "first"), at.where("open").select("node", "least")


def _doubled(at: DataFrame) -> DataFrame:
    above = at.select(
        F.col("node").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("least").alias("lower"), F.col("first").alias("head")
    )
    # Past n steps a pointer is in a loop, where distances mean nothing and would overflow.
    further = F.when(F.col("dist") <= 1 << 60, F.col("dist") + F.coalesce("more", F.lit(0))).otherwise(F.col("dist"))
    return at.join(above.hint("merge"), "up", "left").select(
        "node",
        F.coalesce("next", "up").alias("up"),
        further.alias("dist"),
        F.least("least", "lower").alias("least"),
        F.coalesce("head", "first").alias("first"),
        F.col("next").isNotNull().alias("open"),
    )


def _moved(links: DataFrame, hung: DataFrame, best: str) -> DataFrame:
    """The links into nodes that do not hang, coming from the nodes others hang on."""
    tops = hung.select(F.col("node").alias("src"), "up", "dist")
    inner = links.join(hung.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").join(tops.hint("merge"), "src", "left")
    ends = inner.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"))
    return settle(ends.groupBy("src", "dst").agg(getattr(F, best)("w").alias("w")))


def nearest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): the least number of steps from a root, of all nodes that can be reached."""
    roots = settle(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    links = _weighted(edges.where("src <> dst"))
    hung, _ = hang(links, roots)
    hung = settle(hung)
    links = _moved(links, hung, "min")
    known = frontier = roots.withColumn("depth", F.lit(0).cast("long"))
    rounds = 0
    while not frontier.isEmpty():
        step = links.join(frontier.withColumnRenamed("node", "src"), "src")
        found = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("new"))
        frontier = settle(
            found.join(known, "node", "left").where("depth IS NULL OR new < depth").select("node", F.col("new").alias("depth"))
        )
        rounds += 1
        known = known.unionByName(frontier).groupBy("node").agg(F.min("depth").alias("depth"))
        known = known if rounds % 4 else settle(known)
    known = settle(known)
    below = hung.join(known.withColumnRenamed("node", "up"), "up").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    return known.unionByName(below)


def longest(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a node nothing feeds, of all nodes no cycle feeds."""
    links = _weighted(edges)
    layers = []
    while True:
        hung, _ = hang(links)
        hung = settle(hung)
        if hung.count() * WORTHWHILE <= links.count():
            break
        starts = links.join(links.select(F.col("dst").alias("src")).hint("merge"), "src", "left_anti").select(F.col("src").alias("node"))
        layers.append((hung, settle(starts.distinct())))
        links = _moved(links, hung, "max")
    known = _by_freed_links(links, [starts for _, starts in layers])
    for hung, _ in reversed(layers):
        below = hung.join(known.select(F.col("node").alias("up"), "level").hint("merge"), "up")
        known = settle(known.unionByName(below.select("node", (F.col("level") + F.col("dist")).alias("level"))))
    return known


def _by_freed_links(links: DataFrame, starts: list[DataFrame]) -> DataFrame:
    """Levels round by round: a node is ready when as many of its links are freed as lead to it.

    Counts change only for the nodes that freed links lead to; the others are not touched.
    """
    asked = settle(links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ways")))
    first = links.select(F.col("src").alias("node"))
    for more in starts:
        first = first.union(more)
    ready = settle(first.distinct().join(asked.hint("merge"), "node", "left_anti").withColumn("level", F.lit(0).cast("long")))
    done, pending, rounds = ready, None, 0
    while True:
        freed = links.join(ready.withColumnRenamed("node", "src").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("got"), F.max(F.col("level") + F.col("w")).alias("level")
        )
        if pending is not None:
            freed = freed.unionByName(pending).groupBy("node").agg(F.sum("got").alias("got"), F.max("level").alias("level"))
        counted = settle(freed.join(asked.hint("merge"), "node"))
        ready = counted.where("got = ways").select("node", "level")
        if ready.isEmpty():
            return done
        pending = counted.where("got < ways").select("node", "got", "level")
        rounds += 1
        done = done.unionByName(ready) if rounds % 8 else settle(done.unionByName(ready))


def _after_cycles(edges: DataFrame) -> DataFrame:
    """The links between nodes that are on a cycle or behind one.

    Nodes that nothing feeds are peeled off, which ends soon in a shallow graph; what is
    deeper than ``PEELED`` rounds is found by its levels.
    """
    left, n = edges, edges.count()
    for _ in range(PEELED):
        fed = left.select(F.col("dst").alias("src")).distinct()
        kept = settle(left.join(fed, "src", "left_semi").select("src", "dst"))
        rest = kept.count()
        if rest in (0, n):
            return kept
        left, n = kept, rest
    gone = settle(longest(left).select("node"))
    left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
    return settle(left.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Give each node the least label that can reach it, following only labels that changed."""
    known = changed = labels
    rounds = 0
    while True:
        pushed = links.join(changed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        changed = settle(pushed.join(known, "node").where("new < label").select("node", F.col("new").alias("label")))
        if changed.isEmpty():
            return known
        rounds += 1
        known = known.unionByName(changed).groupBy("node").agg(F.min("label").alias("label"))
        known = known if rounds % 4 else settle(known)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on cycles, with the smallest node of their strongly connected component.

    Trimming leaves the nodes on cycles or behind one. Of these, nodes with one way in and
    one out are part of a chain; a loop of nothing else is a component already, other chains
    are one link each. On what is left every node takes the least label that reaches it; the
    nodes of a label that reach the labelled node back are its component. Those are taken
    out, and the rest is trimmed and labelled again.
    """
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    result = settle(links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")))
    rest = _after_cycles(settle(links.where("src <> dst")))
    while not rest.isEmpty():
        into = rest.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"))
        out = rest.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"))
        stops = settle(into.join(out, "node", "full").where("NOT (ins <=> 1 AND outs <=> 1)").select("node"))
        inner, loops = hang(rest.withColumn("w", F.lit(1).cast("long")), stops)
        chains = inner.select(F.col("node").alias("src"), "up", "first")
        # Links as the stops see them: straight, or at the end of the chain that begins with ``first``.
        short = settle(
            rest.join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
            .join(chains, "src", "left")
            .select(F.coalesce("up", "src").alias("src"), "dst", "first")
            .join(stops.withColumnRenamed("node", "src"), "src", "left_semi")
        )
        # In the order of a hash, so that components in a row are not found one by one.
        own = stops.withColumn("label", F.struct(F.xxhash64("node").alias("h"), "node"))
        labels = settle(_spread(own, short.select("src", "dst").distinct()))
        of_src, of_dst = (labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("src", "dst"))
        within = settle(short.join(of_src, "src").join(of_dst, "dst").where("src_label = dst_label").select("src", "dst", "first", F.col("src_label").alias("label")))
        back = nearest(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), labels.where("node = label.node").select("node"))
        core = settle(back.select("node").join(labels, "node"))
        # A chain belongs to a component if both its ends do, and so do all nodes on it.
        both = within.where("first IS NOT NULL").join(core.select(F.col("node").alias("src")), "src", "left_semi").join(
            core.select(F.col("node").alias("dst")), "dst", "left_semi"
        )
        on_chains = inner.join(both.select("first", "label").distinct(), "first").select("node", "label")
        members = settle(core.unionByName(on_chains))
        # A component of one node is on no cycle.
        many = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("cycle")).where("n > 1")
        found = members.join(many, "label").select("node", "cycle")
        result = result.unionByName(found).unionByName(loops.select("node", F.col("least").alias("cycle")))
        gone = members.select("node").union(loops.select("node")).distinct()
        left = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = _after_cycles(settle(left))
    return result.groupBy("node").agg(F.min("cycle").alias("cycle"))
