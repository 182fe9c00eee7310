"""Packing documents into sequences of a fixed length: best two fit.

Bins are filled greedily, the longest piece that fits first. Then a bin's shortest piece is
replaced by two unpacked pieces, if two of them fit the space it would leave more tightly.

Which pieces fit together depends on their lengths alone, so the search runs on the table of
lengths: one count for each possible length, at most ``capacity`` numbers however large the
corpus is. A filling found there is repeated for as long as the counts of its lengths last.
The result is a short list of fillings; every piece finds its place in it by its length and
its rank among the pieces of that length, ranks being prefix sums over partitions. No
document's tokens are moved.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.llm.common import text_of
from viewgrain.plans.settle import settle

CAPACITY = 2048
#: Id put behind the last token of each document.
END_ID = 0
#: The one added token of the vocabulary; in a text it is one token, as its library has it.
ADDED = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    """Where the vocabulary of byte_bpe_50k lies, as ranks: the same ids as its JSON form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """One encoder per worker process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(
            "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED
        )
    return _ENCODERS[path]


def pieces(lengths_of: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = lengths_of % capacity or min(lengths_of, capacity)
    starts = [0, *range(first, lengths_of, capacity)]
    return [(s, first if s == 0 else capacity) for s in starts]


def tokenise(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids.

    ``ids`` are the piece's tokens as little-endian unsigned 32-bit numbers. A NULL or empty
    text is the end id alone; a document of more than ``capacity`` ids is cut into pieces of
    ``capacity``, what is left over coming first. Rows that repeat are packed each; other
    columns are not read.
    """
    path = vocabulary or vocabulary_path()

    def cut(batches):
        encoder = _encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, numbers, starts, lengths, ids = [], [], [], [], []
            for row, body in enumerate(batch.column("text").to_pylist()):
                raw = np.array(encoder.encode(body, allowed_special="all"), dtype="<u4").tobytes() + end
                for i, (start, length) in enumerate(pieces(len(raw) // 4, capacity)):
                    rows.append(row)
                    numbers.append(i)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(raw[4 * start : 4 * (start + length)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return frame.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


@dataclass(frozen=True)
class Filling:
    """``times`` sequences, each holding ``uses`` pieces of each length."""

    uses: dict[int, int]
    times: int


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Filling]:
    """Fillings that use up ``counts[length]`` pieces of every length from 1 to ``capacity``."""
    left = {int(n): int(c) for n, c in enumerate(counts) if c and n}
    lengths = sorted(left)
    fillings: list[Filling] = []
    while lengths:
        uses: dict[int, int] = {}
        gap = _fill(left, lengths, uses, capacity)
        if gap and len(lengths) > 1:
            shortest = min(uses)
            better = _two_for_one(left, lengths, uses, gap, shortest)
            if better:
                uses[shortest] -= 1
                if not uses[shortest]:
                    del uses[shortest]
                for n in better:
                    uses[n] = uses.get(n, 0) + 1
                _fill(left, lengths, uses, gap + shortest - sum(better))
        times = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
        fillings.append(Filling(uses, times))
    return fillings


def _fill(left: dict[int, int], lengths: list[int], uses: dict[int, int], gap: int) -> int:
    """Put the longest unpacked pieces that fit into the gap; returns what stays free."""
    at = bisect_right(lengths, gap) - 1
    while at >= 0:
        n = lengths[at]
        k = min(left[n] - uses.get(n, 0), gap // n)
        if k > 0:
            uses[n] = uses.get(n, 0) + k
            gap -= k * n
        at = min(at - 1, bisect_right(lengths, gap) - 1)
    return gap


def _two_for_one(
    left: dict[int, int], lengths: list[int], uses: dict[int, int], gap: int, shortest: int
) -> tuple[int, int] | None:
    """The two unpacked lengths that fill ``gap + shortest`` best, if better than before."""
    room = gap + shortest
    free = {n: left[n] - uses.get(n, 0) for n in lengths[: bisect_right(lengths, room - 1)]}
    one = np.array([n for n, c in free.items() if c > 0], dtype=np.int64)
    if not len(one):
        return None
    partner = np.searchsorted(one, np.minimum(one, room - one), side="right") - 1
    single = np.array([free[int(n)] == 1 for n in one])
    partner = np.where((partner >= 0) & (one[partner] == one) & single, partner - 1, partner)
    total = np.where(partner >= 0, one + one[partner], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    if total[best] <= shortest:
        return None
    return int(one[best]), int(one[partner[best]])


def _slots(fillings: list[Filling], capacity: int) -> dict[str, np.ndarray]:
    """For each length, which ranks go where: one slot per filling and length in it."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, first = [], 0
    for filling in fillings:
        offset = 0
        for n in sorted(filling.uses, reverse=True):
            k = filling.uses[n]
            rows.append((n, taken[n], first, k, offset))
            taken[n] += k * filling.times
            offset += k * n
        first += filling.times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "uses", "offset"), columns))


def pack(tokenised: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length`` of 1 to ``capacity``.

    Every other column goes along, so drop what need not be written. Offsets in a sequence
    are gapless from 0. An empty table gives an empty one. Pieces of one length are
    interchangeable, so ties need no order. The list of fillings holds at most a few entries
    per length; it is the only thing sent to the tasks.
    """
    spark = tokenised.sparkSession
    names = tokenised.columns

    def ranked(batches):
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            n = batch.column("length").to_numpy()
            order = np.argsort(n, kind="stable")
            ordered = n[order]
            starts = np.flatnonzero(np.r_[True, np.diff(ordered) != 0])[: len(n)]
            sizes = np.diff(np.r_[starts, len(ordered)])
            rank = np.empty(len(n), dtype=np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(starts, sizes) + seen[ordered]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "__rank"])

    ready = tokenised.withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*ready.schema.fields, T.StructField("__rank", T.LongType())])
    kept = settle(ready.mapInArrow(ranked, schema))
    per_part = kept.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = per_part.select(
        F.col("__part").alias("__p"),
        F.col("length").alias("__l"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"),
    )
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in kept.groupBy("length").agg(F.count(F.lit(1))).collect():  # one row per length
        counts[length] = n
    slots = spark.sparkContext.broadcast(_slots(best_two_fit(counts, capacity), capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, n, r = slots.value, length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(s["length"] * (1 << 40) + s["rank"], n * (1 << 40) + r, side="right") - 1
        inside = r - s["rank"][at]
        return pd.DataFrame(
            {
                "sequence_id": s["sequence"][at] + inside // s["uses"][at],
                "offset": s["offset"][at] + inside % s["uses"][at] * n,
            }
        )

    same = (F.col("__part") == F.col("__p")) & (F.col("length") == F.col("__l"))
    placed = kept.join(base, same).withColumn("__place", place("length", F.col("__rank") + F.col("__base")))
    return placed.select(*names, "__place.sequence_id", "__place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces that kept their ``ids``: sequence_id, n_tokens, ids.

    A sequence holds at most the capacity, so gathering it is bounded.
    """
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex")))), lambda p: p["hex"]), ""
    )
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(joined).alias("ids"))
