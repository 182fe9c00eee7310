"""Mixing sources to target weights: pivotal dependent rounding.

A source that is to give ``target`` words of its ``source_size`` gives each of its documents
``target / source_size`` times on average. The whole part is taken outright. The fractions
are rounded together: two fractional documents are paired, and words are moved at random
from one to the other until one of them is taken once more or not at all. Each document
keeps its expected number of copies, and the words taken by a pair never change, so a source
ends within one document of its target. Pairs are made in buckets; what is left of a bucket,
one fractional document at most, meets the leftovers of other buckets further up a tree.
Long documents are rounded first, so that the one left at the end is short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import SPACE, running_totals, text_of
from viewgrain.plans.settle import settle

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and so the most a source may be asked for in sizes of its own.
MOST_COPIES = 3
#: Documents expected in one bucket, and buckets that meet in one node of the tree.
BUCKET_ROWS, FAN_IN = 512, 64
SEED = 20260


def n_words(text: Column) -> Column:
    """Words between white space; a word starts where a non-space follows a space or nothing."""
    return F.regexp_count(text, F.lit(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target for rows of (source, size).

    Targets are ``level * weight``, cut at ``most`` sizes of the source, at the one level at
    which they add up to all sizes; each round cuts the sources above and raises the level
    of the rest. NULL is a source, and comes last. A source without words has target 0.
    """
    totals = settle(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    )
    ordered = totals.withColumn("__null", F.col("source").isNull().cast("int"))
    numbered = running_totals(ordered, [], ["__null", "source"], {"position": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = settle(numbered.select("source", "source_size", "n_docs", weight.alias("weight")))
    cap = F.col("source_size") * float(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        cut = cap <= F.lit(level) * F.col("weight")
        fixed, open_weight = weighed.agg(
            F.coalesce(F.sum(F.when(cut, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~cut, F.col("weight"))), F.lit(0.0))
        ).first()
        raised = (total - fixed) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return weighed.select(
        "source", "source_size", "n_docs", F.least(cap, F.lit(level) * F.col("weight")).alias("target")
    )


def _random(keys: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each key, always the same: the mixing steps of SplitMix64."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


_EDGE = 1e-9


def pivot(part: np.ndarray, size: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Round fractions ``part`` in pairs until at most one of them is still fractional.

    ``sum(part * size)`` is kept. All pairs of a round are settled at once.
    """
    part = part.copy()
    open_ = np.flatnonzero((part > _EDGE) & (part < 1 - _EDGE))
    turn = 0
    while len(open_) > 1:
        a, b = open_[0 : len(open_) // 2 * 2 : 2], open_[1::2]
        up = np.minimum((1 - part[a]) * size[a], part[b] * size[b])
        down = np.minimum(part[a] * size[a], (1 - part[b]) * size[b])
        with np.errstate(over="ignore"):
            drawn = _random(key[a] * np.int64(31) + key[b] + np.int64(salt * 1_000_003 + turn))
        moved = np.where(drawn * (up + down) < down, up, -down)
        part[a] += moved / size[a]
        part[b] -= moved / size[b]
        part[part < _EDGE] = 0.0
        part[part > 1 - _EDGE] = 1.0
        open_ = open_[(part[open_] > 0) & (part[open_] < 1)]
        turn += 1
    return part


def rounded_by_size(part: np.ndarray, size: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """``pivot`` from the longest documents down, so that what is left over is a short one.

    Documents are taken in tiers, each of half the size of the one before. The leftover of a
    tier is rounded on its own where the next tier can make up for it with equal small changes
    to all its fractions, for either outcome; otherwise it is paired with them.
    """
    part = part.copy()
    tier = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    fractional = (part > _EDGE) & (part < 1 - _EDGE)
    left: int | None = None
    for t in np.unique(tier[fractional])[::-1]:
        pool = np.flatnonzero(fractional & (tier == t))
        if left is not None:
            p, words = part[left], size[pool].sum()
            fewer, more = (1 - p) * size[left] / words, p * size[left] / words
            if part[pool].min() >= fewer and part[pool].max() <= 1 - more:
                up = _random(key[left : left + 1] + np.int64(salt))[0] < p
                part[left] = float(up)
                part[pool] += -fewer if up else more
                part[pool] = np.where(part[pool] < _EDGE, 0.0, np.where(part[pool] > 1 - _EDGE, 1.0, part[pool]))
            else:
                pool = np.append(pool, left)
        part[pool] = pivot(part[pool], size[pool], key[pool], salt + int(t) * 7919)
        rest = pool[(part[pool] > 0) & (part[pool] < 1)]
        left = int(rest[0]) if len(rest) else None
    return part


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, n_rows, copies: one row per different row.

    Rows that repeat one (doc_id, source, size) are one row here, ``n_rows`` of them, with
    ``copies`` in all, at most three for each. The result depends on the rows and the seed
    alone, not on how they are partitioned. Documents without words are taken 0 times. NULL
    texts are empty, a NULL source is a source and a NULL doc_id a document. An empty table
    gives an empty one.
    """
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(text_of(text)).alias("size")
    )
    rows = settle(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    targets = source_targets(
        rows.select("source", (F.col("size") * F.col("n_rows")).alias("size"))
    ).withColumnRenamed("source", "__source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n_rows")
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    hashed = F.xxhash64("doc_id", "size", F.lit(seed))
    laid = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
        .select(
            *["doc_id", "source", "size", "source_size", "target", "n_rows"],
            F.floor("__wanted").alias("copies"),
            (F.col("__wanted") - F.floor("__wanted")).alias("__part"),
            hashed.alias("__hash"),
            F.pmod(F.shiftright(hashed, 8), buckets).alias("__node"),
            F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("__nodes"),
        )
    )
    schema = laid.schema

    def rounded(level: int):
        def run(group: pa.Table) -> pa.Table:
            key = group["__hash"].to_numpy()
            order = np.argsort(key, kind="stable")
            group, key = group.take(order), key[order]
            size = group["size"].to_numpy().astype(np.float64)
            part = rounded_by_size(group["__part"].to_numpy(), size, key, seed + level)
            nodes = group["__nodes"].to_numpy()
            if nodes[0] <= 1:  # the root: one leftover at most, with no partner
                part = np.where((part > 0) & (part < 1), (_random(key + np.int64(seed)) < part).astype(float), part)
            new = {"__part": part, "__node": group["__node"].to_numpy() // FAN_IN, "__nodes": -(-nodes // FAN_IN)}
            for name, values in new.items():
                group = group.set_column(group.schema.get_field_index(name), name, pa.array(values))
            return group

        return run

    decided, level = [], 0
    while True:
        done = settle(laid.groupBy("source", "__node").applyInArrow(rounded(level), schema))
        leftover = (F.col("__part") > 0) & (F.col("__part") < 1)
        decided.append(done.where(~leftover))
        laid = done.where(leftover)
        if laid.isEmpty():
            break
        level += 1
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result.withColumn("copies", F.col("copies") + F.col("__part").cast("long")).drop(
        "__part", "__hash", "__node", "__nodes"
    )


def per_row(mixed: DataFrame) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, copies.

    Repeated rows share their copies as evenly as whole numbers allow.
    """
    n, c = F.col("n_rows"), F.col("copies")
    numbered = mixed.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    own = F.floor(c / n) + (F.col("__i") <= c % n).cast("long")
    return numbered.withColumn("copies", own).drop("n_rows", "__i")


def copied(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix: each row as many times as ``mixed`` takes it.

    Only rows that repeat another's key, source and size are numbered among each other; all
    others are joined to their copies directly. NULL keys and sources are values like any other,
    a NULL text has no words and is never taken; an empty table gives an empty one. The input's
    columns are kept in one struct, so names of its own cannot clash.
    """
    names = docs.columns
    mine = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").alias("source"),
        n_words(text_of(text)).alias("size"),
    )
    on = (
        F.col("key").eqNullSafe(F.col("__k"))
        & F.col("source").eqNullSafe(F.col("__s"))
        & (F.col("size") == F.col("__n"))
    )
    wanted = mixed.where("copies > 0").select(
        F.col("doc_id").alias("__k"),
        F.col("source").alias("__s"),
        F.col("size").alias("__n"),
        F.col("n_rows").alias("__rows"),
        F.col("copies").alias("__copies"),
    )
    found = mine.join(wanted, on)
    single = found.where("__rows = 1").withColumn("__own", F.col("__copies"))
    if not wanted.where("__rows > 1").isEmpty():
        numbered = running_totals(
            found.where("__rows > 1").withColumn("__id", F.monotonically_increasing_id()),
            ["__k", "__s", "__n"],
            ["__id"],
            {"__i": F.lit(1)},
        )
        c, n = F.col("__copies"), F.col("__rows")
        share = F.floor(c / n) + (F.col("__i") < c % n).cast("long")
        single = single.unionByName(numbered.withColumn("__own", share).select(*single.columns))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own")))
    return single.where("__own > 0").withColumn("__time", times).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
