"""Near-duplicates by SuperMinHash signatures: banding, verification, union of the links.

An element of a set gets a random rank for each place of the signature, and the places come
in an order that is a random permutation of its own: the value at the j-th of them is j plus
a random fraction. A place of the signature holds the least value that an element of the set
gives it. As the places of one element have different ranks, the signature varies less than
one of independent hashes, and as ranks only grow, elements need no further ranks once every
place holds less: a long text is done after one or two.

Equal sets are one class from the start, so copies never meet. Classes whose signatures agree
in a whole band share a bucket; every member of a bucket is verified, on full sets, against
its leader, the class that shares most bands with others, never pair by pair. That settles
most buckets. The classes of a bucket that still falls into several components are searched
again in full: each names its rarest shingles, as many as a link may miss, and classes of
different components that name one in common are verified. So no bucket has a cap, and a large
group of copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import text_of, with_row_key
from viewgrain.llm.components import components
from viewgrain.plans.settle import settle

SHINGLE = 3
#: Sets link if they share 85 of 100 of all their shingles.
SHARE = 85
#: At that similarity a pair agrees in none of 24 bands of four once in 50 million times.
BANDS, BAND_ROWS = 24, 4
PLACES = BANDS * BAND_ROWS
SEED = 42
#: Words hashed, elements ranked at a time, so a long text needs no more memory than a short one.
WORDS_AT_ONCE = 1 << 16
ELEMENTS_AT_ONCE = 1 << 15

_GOLDEN = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles; of all words where they are fewer."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = []
    for at in range(0, len(words) - shingle + 1, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        parts.append(np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _random(elements: np.ndarray, rank: int) -> np.ndarray:
    """64 random bits for each element at a rank."""
    x = elements + np.uint64((rank + 1) * _GOLDEN % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, sizes: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature of each set, a row of ``places``; ``elements`` holds the sets one after another.

    A value holds its rank in the high bits and the random fraction below. All sets take the
    same rank at a time; one drops out once its largest value is below the next rank.
    """
    values = np.full((len(sizes), places), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order: np.ndarray | None = None  # each element's permutation, once its first place is taken
    for rank in range(places):
        drawn = _random(elements, rank)
        swap = rank + (drawn % np.uint64(places - rank)).astype(np.int64)
        if order is None:
            place = swap
        else:
            row = np.arange(len(elements))
            place = order[row, swap]
            order[row, swap] = order[:, rank]
        value = (np.uint64(rank) << np.uint64(40)) | (drawn >> np.uint64(24))
        np.minimum.at(values.reshape(-1), owner * places + place, value)
        open_ = (values.max(axis=1) >> np.uint64(40)) > np.uint64(rank)
        stay = open_[owner]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (int(stay.sum()), 1))
            order[np.arange(len(order)), swap[stay]] = 0
        else:
            order = order[stay]
        elements, owner = elements[stay], owner[stay]
    return values


def _bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the number of the band is part of it."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLDEN), (len(values), BANDS)).copy()
    for i in range(BAND_ROWS):
        keys = _random(keys ^ values[:, i::BAND_ROWS], i)
    return keys


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set) and its band keys."""
    import xxhash

    for batch in batches:
        texts = batch.column("text")
        at = 0
        while at < len(texts):
            sets, held = [], 0
            start = at
            while at < len(texts) and held < ELEMENTS_AT_ONCE:
                sets.append(shingle_set(texts[at].as_py()))
                held += len(sets[-1])
                at += 1
            sizes = np.array([len(s) for s in sets])
            keys = _bands(signatures(np.concatenate(sets), sizes)).view(np.int64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, len(sets)),
                    pa.array(sizes.astype(np.int64)),
                    pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                ],
                names=["doc_id", "n_shingles", "set_id", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_id and the sorted hashes of the set, little-endian."""
    import xxhash

    for batch in batches:
        for text in batch.column("text"):
            held = shingle_set(text.as_py()).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh128_digest(held, SEED)], pa.binary()), pa.array([held], pa.binary())],
                names=["set_id", "shingles"],
            )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are as similar as asked."""
    for batch in batches:
        near = []
        for mine, theirs in zip(batch.column("mine"), batch.column("theirs")):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (mine, theirs))
            shared = len(x) + len(y) - len(np.union1d(x, y))
            near.append(100 * shared >= SHARE * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.encode(text_of(f"`{text}`"), "UTF-8").alias("text"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link, by their full sets."""
    mine = sets.select(F.col("node").alias("a"), F.col("shingles").alias("mine"))
    theirs = sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs"))
    return pairs.join(mine, "a").join(theirs, "b").select("a", "b", "mine", "theirs").mapInArrow(_linked, "a long, b long")


def _fits(small: Column, large: Column) -> Column:
    """Whether the sizes of two sets allow a link at all."""
    return 100 * small >= SHARE * large


def shared_buckets(classes: DataFrame) -> DataFrame:
    """node, size, key, n: the buckets with more than one member, and how many that is."""
    rows = classes.select("node", "size", F.explode("bands").alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(counted, "key")


def leader_pairs(shared: DataFrame, weight: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's leader.

    The leader is the member of most ``weight``: whose buckets are fullest, which in a group
    of copies of one text is that text or what is closest to it.
    """
    leaders = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("lead"))
    joined = shared.join(leaders, "key").where(F.col("node") != F.col("lead.node"))
    fitting = joined.where(_fits(F.least("size", "lead.size"), F.greatest("size", "lead.size")))
    return fitting.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


#: Links that a node looks along for the heaviest node around it.
HOPS = 3


def joined_to(first: DataFrame, weight: DataFrame) -> DataFrame:
    """node, component: the node of most weight within ``HOPS`` links, or itself.

    Nodes of one component here are linked; others may be too, which only costs a comparison.
    """
    both = first.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        first.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    around = weight.select("node", F.struct("weight", "node").alias("top"))
    for _ in range(HOPS):
        seen = both.join(around.select(F.col("node").alias("other"), "top"), "other").select("node", "top")
        around = settle(around.unionByName(seen).groupBy("node").agg(F.max("top").alias("top")))
    return around.select("node", F.col("top.node").alias("component"))


def _shingles(frame: DataFrame) -> DataFrame:
    """One row per shingle of a set: the bytes, cut in Python, go no further than this."""

    def run(batches):
        for batch in batches:
            for row, held in enumerate(batch.column("shingles")):
                tokens = pa.array(np.frombuffer(held.as_buffer(), np.int64))
                same = pa.array(np.full(len(tokens), row))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(same) for c in ("node", "size", "component")], tokens],
                    names=["node", "size", "component", "token"],
                )

    return frame.select("node", "size", "component", "shingles").mapInArrow(run, "node long, size long, component long, token long")


def rare_shingle_pairs(open_sets: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of different components that may link, by the shingles they name.

    ``open_sets`` has node, size, component, shingles. With the shingles in one order, the
    rarest first, two sets that link have their first common shingle early: among the first
    ``size - ceil(0.85 size) + 1`` of the larger and ``size - ceil(170 / 185 size) + 1`` of
    the smaller, and not so late that too few are left. Pairs without such a shingle cannot
    link, so this loses none. Shingles met in one component only are left out.
    """
    tokens = settle(_shingles(open_sets))
    common = (
        tokens.groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), (F.min("component") < F.max("component")).alias("crosses"))
        .where("df > 1")
    )
    # Shingles of one set alone come first and name no partner: only their number counts.
    met = tokens.join(common, "token")
    ordered = F.array_sort(F.collect_list(F.struct("df", "token", "crosses")))  # of one set
    ranked = met.groupBy("node", "size", "component").agg(ordered.alias("all"))
    alone = F.col("size") - F.size("all")
    most = F.col("size") - F.floor((SHARE * F.col("size") + 99) / 100) + 1
    named = ranked.select(
        "node", "size", "component", alone.alias("alone"),
        F.posexplode(F.slice("all", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))).alias("at", "s"),
    ).where("s.crosses")
    least = F.col("size") - F.floor((2 * SHARE * F.col("size") + 99 + SHARE) / (100 + SHARE)) + 1
    placed = settle(named.select("node", "size", "component", F.col("s.token").alias("token"), (F.col("alone") + F.col("at") + 1).alias("at"), least.alias("least")))
    large = placed.drop("least")
    small = placed.where("at <= least").select(*[F.col(c).alias(f"{c}_s") for c in ("node", "size", "component", "token", "at")])
    left = 1 + F.least(F.col("size") - F.col("at"), F.col("size_s") - F.col("at_s"))
    met_by = (
        (F.col("token") == F.col("token_s"))
        & (F.col("component") != F.col("component_s"))
        & ((F.col("size_s") < F.col("size")) | ((F.col("size_s") == F.col("size")) & (F.col("node_s") < F.col("node"))))
        & _fits(F.col("size_s"), F.col("size"))
        & ((100 + SHARE) * left >= SHARE * (F.col("size") + F.col("size_s")))
    )
    found = large.join(small, met_by)
    return found.select(F.least("node", "node_s").alias("a"), F.greatest("node", "node_s").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): links between nodes of ``classes`` that join all nodes of a component."""
    shared = settle(shared_buckets(classes))
    members = settle(shared.select("node").distinct().join(classes.select("node", "size", "set_id", "least"), "node"))
    # Texts are found by doc_id and known by their digest, so repeated ids do no harm.
    ids = members.select(F.col("least").alias("__least")).distinct()
    again = _texts(docs, key, text).join(ids, F.col("doc_id").eqNullSafe(F.col("__least")), "left_semi")
    full = again.mapInArrow(_full_sets, "set_id binary, shingles binary")
    sets = settle(full.join(members, "set_id").select("node", "size", "shingles").dropDuplicates(["node"]))
    weight = settle(shared.groupBy("node").agg(F.sum("n").alias("weight")))
    first = settle(verified(leader_pairs(shared, weight), sets))
    grouped = shared.join(joined_to(first, weight), "node").select("node", "key", "component")
    still = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    # A bucket of two is settled by its one pair.
    open_keys = still.where("low < high and n > 2").select("key")
    open_nodes = settle(grouped.join(open_keys, "key").select("node", "component").distinct())
    if open_nodes.isEmpty():
        return first
    return first.unionByName(verified(rare_shingle_pairs(sets.join(open_nodes, "node")), sets))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Texts link if their sets of word shingles share ``SHARE`` of 100 of all their shingles.
    ``component_id`` is the smallest doc_id reachable over links, its own included. NULL,
    empty and blank texts have no shingle and link with nothing. Equal sets are one class
    however often they occur; rows that repeat get a row each. A NULL doc_id counts only
    where a component has no other, and is kept there. An empty table gives an empty one;
    other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>"
    described = settle(_texts(docs, key, text).mapInArrow(_described, schema))
    classes = with_row_key(
        described.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")),
        "node",
    )
    found = components(settle(links(docs, classes, key, text))).withColumnRenamed("node", "__node")
    named = settle(
        classes.join(found, F.col("node") == F.col("__node"), "left").select(
            F.col("set_id").alias("__set"), "least", F.coalesce("component", "node").alias("component")
        )
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = named.join(smallest, "component").select("__set", "component_id")
    joined = described.drop("bands").join(owner, F.col("set_id") == F.col("__set"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
