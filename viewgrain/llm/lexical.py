"""Ranked lexical search by bag deduplication.

A query set is ranked against all documents. For that only the words of the queries matter,
so a document is its bag: how often it has each of them, and the part of the score that its
length decides. Documents with the same bag score alike for every query, whatever else they
say: they are one class, told apart by a hash and by the whole bag, and scored once. Tasks
keep the best classes of each query; only the winning classes are expanded to their members,
by ascending doc_id.

Queries come in blocks of bounded vocabulary, which is all that is ever broadcast; each
block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewgrain.llm.common import running_totals, text_of, with_row_key
from viewgrain.plans.settle import settle

#: Most different words of a block of queries, and most queries in it; one query is never split.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 1 << 12
#: Scores that a task holds at a time, and products that it adds up at a time.
SCORES_AT_ONCE, PRODUCTS_AT_ONCE = 1 << 21, 1 << 20
#: Groups in which the best of all tasks meet before the last choice.
MERGES = 32
BEST = 20

#: Letters and digits as they are, A-Z in lower case, all other ASCII as a space.
_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters, digits and all that is not ASCII."""
    return text.translate(_TERMS).split()


def _bytes(frame: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return frame.select(F.col(f"`{key}`").alias(name), F.encode(text_of(f"`{text}`"), "UTF-8").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, item and the number of different words of each query."""
    for batch in batches:
        n = [len(set(terms(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("item"), batch.column("text"), pa.array(n, pa.int64())],
            names=["item_id", "item", "text", "n"],
        )


def query_blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, list]:
    """The queries with a word (item_id, item, text, block), settled, and the blocks there are."""
    rows = with_row_key(_bytes(items, key, text, "item_id"), "item")
    kind = rows.schema["item_id"].dataType.simpleString()
    counted = settle(rows.mapInArrow(_counted, f"item_id {kind}, item long, text binary, n long").where("n > 0"))
    totals = {"__terms": F.col("n"), "__items": F.lit(1)}
    dealt = running_totals(counted, [], ["item"], totals)
    block = F.struct(F.floor(F.col("__terms") / BLOCK_TERMS).alias("t"), F.floor(F.col("__items") / BLOCK_ITEMS).alias("i"))
    blocks = settle(dealt.select("item_id", "item", "text", block.alias("block")))
    return blocks, [r.block for r in blocks.select("block").distinct().orderBy("block").collect()]


class Queries:
    """The words of a block of queries, numbered, and which queries ask for each how often."""

    def __init__(self, rows: list):
        self.items = [r.item for r in rows]
        counts = [Counter(terms(bytes(r.text))) for r in rows]
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        asked = sorted((self.numbers[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*asked))
        self.first = np.searchsorted(term, np.arange(len(self.numbers) + 1))


def bags(docs: DataFrame, queries, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (words in all), terms, tfs: the words of the queries in a document, by number."""

    def run(batches):
        number = queries.value.numbers.get
        for batch in batches:
            lengths, found, tfs, ends = [], [], [], [0]
            for t in batch.column("text"):
                words = terms(t.as_py())
                lengths.append(len(words))
                asked = np.array([i for i in map(number, words) if i is not None], np.int32)
                own, times = np.unique(asked, return_counts=True)
                found.append(own)
                tfs.append(times.astype(np.int32))
                ends.append(ends[-1] + len(own))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]
            )

    frame = _bytes(docs, key, text, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return frame.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequency(held: DataFrame, size: int) -> np.ndarray:
    """In how many of the bags each of ``size`` words is: one row of counts per task and word."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["term", "n"])

    df = np.zeros(size, np.int64)
    for row in held.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row.term] = row.n
    return df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def _best(item: np.ndarray, score: np.ndarray, least: np.ndarray, own: np.ndarray, most: int) -> list[np.ndarray]:
    """The ``most`` rows of each item with the highest score, then the smallest doc_id."""
    order = np.lexsort((least, -score, item))
    ordered = item[order]
    keep = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < most]
    return [x[keep] for x in (item, score, least, own)]


def scored(classes: DataFrame, queries, weight, best: int = BEST) -> DataFrame:
    """item, class, least, score: of each task the ``best`` classes for each query."""

    def run(batches):
        q, w = queries.value, weight.value
        width = len(q.items)
        top = [np.zeros(0, np.int64) for _ in range(4)]
        reach = np.ones(width, np.int64)  # the score a class needs to be among the best so far
        step = max(1, SCORES_AT_ONCE // width)
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                rows = len(batch)
                n = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(rows), n)
                term = batch.column("terms").flatten().to_numpy(zero_copy_only=False)
                tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = batch.column("m").to_numpy(zero_copy_only=False)[row]
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                scores = np.zeros(rows * width, np.int64)
                asked = q.first[term + 1] - q.first[term]
                cuts = np.searchsorted(np.cumsum(asked), np.arange(0, asked.sum(), PRODUCTS_AT_ONCE), side="left")
                for a, b in zip(cuts, [*cuts[1:], len(term)]):
                    k = asked[a:b]
                    one = np.repeat(np.arange(a, b), k)
                    by = q.first[term[one]] + np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k)
                    np.add.at(scores, row[one] * width + q.item[by], gain[one] * q.times[by])
                scores = scores.reshape(rows, width)
                need = reach
                if rows > best:
                    need = np.maximum(reach, np.partition(scores, rows - best, axis=0)[rows - best])
                own, item = np.nonzero(scores >= need)
                least = batch.column("least").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                known = batch.column("class").to_numpy(zero_copy_only=False)
                new = (item, scores[own, item], least[own], known[own])
                top = _best(*(np.concatenate(x) for x in zip(top, new)), best)
                full = np.flatnonzero(np.bincount(top[0], minlength=width) >= best)
                reach[full] = top[1][np.searchsorted(top[0], full, side="right") - 1]
        names = pa.array(np.array(q.items, np.int64)[top[0]])
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(top[3]), pa.array(top[2]), pa.array(top[1])], names=["item", "class", "least", "score"]
        )

    return classes.mapInArrow(run, "item long, class long, least long, score long")


def _search_block(docs: DataFrame, rows: list, best: int, key: str, text: str) -> DataFrame:
    """item, doc_id, score, rank for one block of queries."""
    spark = docs.sparkSession
    queries = Queries(rows)
    shared = spark.sparkContext.broadcast(queries)
    held = settle(bags(docs, shared, key, text))
    documents, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = spark.sparkContext.broadcast(weights(document_frequency(held, len(queries.numbers)), documents))
    m = F.expr(f"75L + (25L * n * {documents}L) div {max(length, 1)}L").alias("m")
    bag = ["h", "m", "terms", "tfs"]
    keyed = held.where(F.size("terms") > 0).select("doc_id", m, "terms", "tfs").withColumn("h", F.xxhash64("m", "terms", "tfs"))
    classes = with_row_key(keyed.groupBy(*bag).agg(F.min("doc_id").alias("least")), "class")

    def first(over: list[str], by: list) -> Column:
        return F.row_number().over(W.partitionBy(*over).orderBy(*by))

    order = [F.col("score").desc(), F.col("least").asc()]
    found = scored(classes, shared, weight, best).withColumn("merge", F.pmod(F.xxhash64("class"), F.lit(MERGES)))
    near = found.withColumn("place", first(["item", "merge"], order)).where(F.col("place") <= best)
    winners = settle(near.withColumn("place", first(["item"], order)).where(F.col("place") <= best).select("item", "class", "score"))
    won = settle(classes.join(winners.select("class").distinct(), "class").select("class", *[F.col(c).alias(f"{c}_w") for c in bag]))
    same = F.col("h") == F.col("h_w")
    for c in bag[1:]:
        same = same & (F.col(c) == F.col(f"{c}_w"))
    members = keyed.join(won, same).select("class", "doc_id")
    lowest = settle(members.withColumn("place", first(["class"], [F.col("doc_id").asc_nulls_last()])).where(F.col("place") <= best))
    ranked = winners.join(lowest.drop("place"), "class").withColumn(
        "rank", first(["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    )
    return ranked.where(F.col("rank") <= best).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each query with a score above 0.

    Equal scores rank by ascending doc_id, NULL last; doc_id is an integer. A NULL text has no
    words; a document without words is not counted, a query without words finds nothing. A
    row that repeats is a document or a query of its own. Empty tables give an empty one;
    other columns are not read.
    """
    blocks, names = query_blocks(items, item_key, item_text)
    results = []
    for name in names:
        mine = blocks.where((F.col("block.t") == name.t) & (F.col("block.i") == name.i))
        rows = mine.select("item", "text").orderBy("item").collect()  # BLOCK_TERMS words and one query at most
        results.append(_search_block(docs, rows, best, key, text))
    if not results:
        kind = items.schema[item_key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    ranked = reduce(DataFrame.unionByName, results)
    return ranked.join(blocks.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
