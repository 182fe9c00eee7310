"""Near-duplicates by SimHash fingerprints: a binary trie joined with itself.

The distinct fingerprints, in order, are a binary trie: a node is a run of fingerprints that
begin with the same bits. Two nodes are traversed together, bit by bit, counting the bits in
which they differ; a pair of nodes is given up once it differs in more bits than allowed.

Of 64 bits in ``budget + 1`` blocks, two fingerprints that differ in no more than ``budget``
bits agree in at least one whole block. So there are ``budget + 1`` tries, each of the
fingerprints rotated so that another block leads, and in each trie no differing bit is
allowed within its leading block. That makes a fingerprint part of ``budget + 1`` subtrees
rather than of all within reach.

Spark deals out the node pairs: a pair of subtrees with few fingerprints goes to one task,
which traverses it in numpy; a larger one is split into its children's pairs first, however
skewed the fingerprints are. A task returns a spanning forest of the links it finds, at most
one link per fingerprint, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import spare, text_of, with_row_key
from viewgrain.llm.components import components
from viewgrain.plans.settle import settle

BITS = 64
SHINGLE = 3
SEED = 42
BUDGET = 2
#: Words hashed at a time, so a long text needs no more memory than a short one.
WORDS_AT_ONCE = 1 << 16
#: Fingerprints a pair of subtrees may hold to go to one task: the least and most of such a
#: limit; in between it is this share of all fingerprints.
LEAST_IN_TASK, MOST_IN_TASK, SHARE_OF_ALL = 1024, 1 << 20, 64
#: Levels by which a pair of subtrees is split at a time.
STRIDE = 2
#: Node pairs a task holds at a time.
FRONTIER = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text: bit b is set if over half of the hashes set it."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((ones * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint of each document as a signed number."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            column = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), column], ["doc_id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.col(key).alias("key"), F.encode(text_of(text), "UTF-8").alias("text"))
    return frame.mapInArrow(run, f"doc_id {kind}, fp long")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of the blocks, from the highest bit."""
    edges = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def rotated(values: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return values
    return (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def _children(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where, between low and high, the fingerprints with a one at this bit begin."""
    shift = np.uint64(BITS - 1 - depth)
    first_one = ((values[low] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(values, first_one), low, high)


def trie_links(
    a: np.ndarray, b: np.ndarray | None, depth: int, differing: int, exact: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of fingerprints within the budget, for two sorted subtrees.

    ``b`` is None for a subtree with itself. The first ``exact`` levels allow no differing
    bit. Pairs of small nodes are compared outright.
    """
    own, other = b is None, a if b is None else b
    zero = np.zeros(1, dtype=np.int64)
    stack = [(depth, zero, zero + len(a), zero, zero + len(other), zero + differing)]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        small = (ahi - alo) * (bhi - blo) <= 8
        if depth >= BITS:
            small[:] = True
        if small.any():
            n = bhi[small] - blo[small]
            size = (ahi[small] - alo[small]) * n
            node = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
            i, j = alo[small][node] + place // n[node], blo[small][node] + place % n[node]
            near = np.bitwise_count(a[i] ^ other[j]) <= budget
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        amid, bmid = _children(a, alo, ahi, depth), _children(other, blo, bhi, depth)
        crossing = alo >= 0
        if own:
            crossing = (alo != blo) | (ahi != bhi)  # a node with itself has one mixed pair
        pairs = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            tuple(x[crossing] for x in (amid, ahi, blo, bmid, diff + 1)),
        ]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*pairs))
        depth += 1
        alive = (ahi > alo) & (bhi > blo) & (diff <= (0 if depth <= exact else budget))
        if alive.any():
            stack.append((depth, *(x[alive] for x in (alo, ahi, blo, bhi, diff))))


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of all links one label, the smallest, in place."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` within ``budget`` differing bits."""
    spark = distinct.sparkSession
    blocks = _blocks(budget)
    n = distinct.count()
    limit = max(LEAST_IN_TASK, min(MOST_IN_TASK, n // SHARE_OF_ALL))
    narrow = min(width for _, width in blocks)
    depth = min(max(n // limit, 1).bit_length(), narrow)
    fp = F.col("fp")

    def turned(first: int) -> Column:
        return F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, BITS - first)) if first else fp

    tries = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), turned(first).alias("bits")) for t, (first, _) in enumerate(blocks)])).alias("t")).select("fp", "t.trie", "t.bits")
    exact = F.element_at(F.array(*[F.lit(w) for _, w in blocks]), F.col("trie") + 1)

    def node(at: int) -> Column:
        return F.shiftrightunsigned("bits", BITS - at) if at < BITS else F.col("bits")

    def counted(at: int) -> DataFrame:
        return tries.groupBy("trie", node(at).alias("node")).agg(F.count(F.lit(1)).alias("n"))

    first = settle(counted(depth))
    pairs = first.select("trie", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("diff"), F.col("n").alias("na"), F.col("n").alias("nb"))
    ready: list[tuple[int, DataFrame]] = []
    while True:
        held = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        fits = (held <= limit) if depth < BITS else F.lit(True)
        ready.append((depth, pairs.where(fits)))
        large = pairs.where(~fits)
        if depth >= BITS or large.isEmpty():
            break
        step = min(STRIDE, BITS - depth)
        depth += step
        nodes = settle(counted(depth))
        child = lambda side: nodes.select(
            F.col("trie").alias(f"trie_{side}"), F.shiftrightunsigned("node", step).alias(f"up_{side}"), F.col("node").alias(f"child_{side}"), F.col("n").alias(f"n_{side}")
        )
        grown = (
            large.join(child("a"), (F.col("trie") == F.col("trie_a")) & (F.col("a") == F.col("up_a")))
            .join(child("b"), (F.col("trie") == F.col("trie_b")) & (F.col("b") == F.col("up_b")))
            .withColumn("diff", F.col("diff") + F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND(F.lit((1 << step) - 1))))
            .where((F.col("a") != F.col("b")) | (F.col("child_a") <= F.col("child_b")))
            .where(F.col("diff") <= F.when(F.lit(depth) <= exact, 0).otherwise(budget))
        )
        pairs = settle(grown.select("trie", F.col("child_a").alias("a"), F.col("child_b").alias("b"), "diff", F.col("n_a").alias("na"), F.col("n_b").alias("nb")))

    dealt: DataFrame | None = None
    for at, todo in ready:
        ends = todo.select("trie", "a", "b", "diff", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        mine = (
            tries.withColumn("node", node(at))
            .join(ends, ["trie", "node"])
            .select("trie", F.lit(at).alias("depth"), "a", "b", "diff", (F.col("node") == F.col("a")).alias("left"), "bits")
        )
        dealt = mine if dealt is None else dealt.unionByName(mine)

    widths, firsts = [w for _, w in blocks], [f for f, _ in blocks]

    def traverse(key: tuple, group: pa.Table) -> pa.Table:
        trie, depth, low, high = (k.as_py() for k in key)
        bits = group["bits"].to_numpy().view(np.uint64)
        left = group["left"].to_numpy(zero_copy_only=False)
        a = np.sort(bits[left])
        b = None if low == high else np.sort(bits[~left])
        both = a if b is None else np.concatenate([a, b])
        labels = np.arange(len(both))
        for i, j in trie_links(a, b, depth, group["diff"][0].as_py(), widths[trie], budget):
            _merge(labels, i, j + (0 if b is None else len(a)))
        linked = np.flatnonzero(labels != np.arange(len(both)))
        back = rotated(both, (BITS - firsts[trie]) % BITS).view(np.int64)
        return pa.table({"a": pa.array(back[linked]), "b": pa.array(back[labels[linked]])})

    return dealt.groupBy("trie", "depth", "a", "b").applyInArrow(traverse, "a long, b long")


def _owners(prints: DataFrame, budget: int) -> DataFrame:
    """fp, least, component: the component of each fingerprint, and its smallest doc_id."""
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = settle(components(links(nodes, budget)))
    return settle(nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    ))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """doc_id, fp, fingerprint, component_id: one row per document.

    ``component_id`` is the smallest doc_id that is reachable over links of at most
    ``budget`` differing bits, its own included; NULL if all there are NULL. NULL and empty
    texts have fingerprint zero and are linked like others. Equal fingerprints are one node
    of the graph, so copies are never paired. Rows that repeat get a row each; an empty table
    gives an empty one.
    """
    prints = settle(fingerprints(docs, key, text, shingle))
    owner = _owners(prints, budget)
    smallest = settle(owner.groupBy("component").agg(F.min("least").alias("component_id")))
    named = settle(owner.join(smallest, "component").select(F.col("fp").alias("__fp"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("__fp")).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs`` that stays of each component: the one with the smallest doc_id, NULL last.

    Rows are told apart by a key of their own, so ids that repeat or are NULL neither remove
    other documents nor keep copies. A NULL text is an empty one and alike to other empty ones; an
    empty table gives an empty one. Columns may have any names.
    """
    names = docs.columns
    row = spare(names, "row")
    rows = with_row_key(docs, row)
    # Id and row together are the key that goes with a fingerprint.
    keyed = rows.select(F.struct(F.col(f"`{key}`").alias("id"), F.col(row).alias("row")).alias("__key"), F.col(f"`{text}`").alias("__text"))
    prints = settle(fingerprints(keyed, "__key", "__text"))
    owner = _owners(prints, BUDGET).select(F.col("fp").alias("__fp"), "component")
    own = settle(prints.join(owner, F.col("fp") == F.col("__fp")).select("doc_id.id", "doc_id.row", "component"))
    first = own.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("__stays"))
    gone = settle(own.join(first, F.col("row") == F.col("__stays"), "left_anti").select(F.col("row").alias(row)))
    left = rows.join(gone, row, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in names])
