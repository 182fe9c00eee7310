"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are words; the edit bound is one word put in, left out or replaced. Two lines within it
share a variant: the line itself, or the line less one word. All variants are emitted as
hashed keys and lines that share a key are joined, by way of the earliest line of each key,
never pair by pair:

* lines less the word at one place, and equal then, differ in that word alone, so each of
  them is joined to the earliest of them;
* a line less any one word that equals a whole line is within one edit of it; the shorter
  line is joined to the earliest of the longer ones, each of those to the shorter one.

Variants are only emitted for lines that can have a partner at all: of two lines within one
edit, the first or the second half of the shorter is the beginning or the end of both.
"""

from __future__ import annotations

import hashlib
import io
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import text_of
from viewgrain.plans.settle import settle

#: With one edit, lines of five words or more are four fifths alike; shorter ones must be equal.
LEAST_WORDS = 5
#: An odd number, so that it has an inverse modulo 2 to the 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
HALVES = ["half0", "half1", "half2", "half3"]

#: What a NULL doc_id counts as in a place: one less than any long.
_NO_DOC = str(-(1 << 63) - 1)


def _place(doc: Column, line: Column) -> Column:
    """A line's place as one number that sorts like (doc_id, line); NULL doc_ids come first."""
    known = F.coalesce(doc.cast("decimal(20,0)"), F.lit(_NO_DOC).cast("decimal(20,0)"))
    return (known * (1 << 31) + line).cast("decimal(38,0)")


def _unplaced(place: Column) -> tuple[Column, Column]:
    """(doc_id, line) of a place."""
    line = F.pmod(place, F.lit(1 << 31))
    doc = ((place - line) / (1 << 31)).cast("decimal(20,0)")
    return F.when(doc != F.lit(_NO_DOC).cast("decimal(20,0)"), doc).cast("long"), line.cast("int")


#: Lines that one Arrow batch carries back from Python.
LINES_OUT = 10_000


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """(rows, line numbers, words) of the lines that have a word, ``LINES_OUT`` at a time.

    ``bytes.split`` parts words at exactly the white space of ``SPACE``, and a text is walked
    line by line, so a very long one never lies in memory as a list of all its words.
    """
    rows: list[int] = []
    numbers: list[int] = []
    parts: list[list[bytes]] = []
    for row, text in enumerate(batch.column("text")):
        for number, raw in enumerate(io.BytesIO(text.as_py())):
            words = raw.split()
            if words:
                rows.append(row)
                numbers.append(number)
                parts.append(words)
                if len(rows) == LINES_OUT:
                    yield rows, numbers, parts
                    rows, numbers, parts = [], [], []
    if rows:
        yield rows, numbers, parts


def _half_keys(line: bytes, words: list[bytes]) -> list[int]:
    """Keys of the first and last half of the words, for a partner of as many or one word less.

    The halves of ``n`` and of ``n - 1`` words begin and end on either side of one word, so
    they are cut from the line at the two ends of that word.
    """
    n = len(words)
    middle = (n - 1) // 2
    ahead = len(b" ".join(words[:middle]))
    behind = ahead + len(words[middle]) + 2
    first, rest = line[:ahead], line[behind:]
    if n % 2:
        half, last = first, line[ahead + 1 :]
    else:
        half, last = line[: behind - 1], rest
    key = xxhash.xxh64_intdigest
    return [key(half, 2 * n), key(last, 2 * n + 1), key(first, 2 * n - 2), key(rest, 2 * n - 1)]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, line_no, line_id and four half keys, NULL for lines too short for a partner."""
    for batch in batches:
        for rows, numbers, parts in _numbered(batch):
            lines = [b" ".join(words) for words in parts]
            long = np.array([len(words) >= LEAST_WORDS for words in parts])
            keys: list[int] = []
            for line, words in zip(lines, parts):
                keys += _half_keys(line, words) if len(words) >= LEAST_WORDS else (0, 0, 0, 0)
            halves = np.array(keys, np.uint64).view(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array([hashlib.md5(line, usedforsecurity=False).digest() for line in lines], pa.binary()),
                    *[pa.array(np.ascontiguousarray(halves[:, i]), mask=~long) for i in range(4)],
                ],
                names=["doc_id", "line_no", "line_id", *HALVES],
            )


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, line_no, place, line_id and half keys of every line that has a word."""
    whole = docs.select(F.col(key).alias("doc_id"), text_of(text).cast("binary").alias("text"))
    kind = whole.schema["doc_id"].dataType.simpleString()
    halves = ", ".join(f"{half} bigint" for half in HALVES)
    found = whole.mapInArrow(_described, f"doc_id {kind}, line_no int, line_id binary, {halves}")
    return found.withColumn("place", _place(F.col("doc_id"), F.col("line_no")))


def _spelled(docs: DataFrame, able: DataFrame, key: str, text: str) -> DataFrame:
    """line_id, first, line: the lines at the first places of ``able``, white space evened out.

    Rows that repeat a doc_id share places, so the line has to be the one named as well; that
    is asked of the lines found by place once they are written, as a filter would otherwise
    become one more key of the join and have every line evened out. The places grow with the
    corpus, so they are merged with the lines at every size rather than broadcast at small ones.
    """
    doc, line_no = _unplaced(F.col("first"))
    wanted = able.select("line_id", "first", doc.alias("__doc"), line_no.alias("__no"))
    split = docs.select(F.col(key).alias("__key"), F.posexplode(F.split(text_of(text), "\n")).alias("__at", "raw"))
    placed = split.join(wanted.hint("merge"), F.col("__key").eqNullSafe(F.col("__doc")) & (F.col("__at") == F.col("__no")))
    found = settle(placed.select("line_id", "first", "raw"))
    even = F.trim(F.regexp_replace("raw", r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    return found.select("line_id", "first", even.alias("line")).where(F.unhex(F.md5("line")) == F.col("line_id"))


def _variant_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line_id, first, at, key): the line less the word at each place, the whole line at place 0.

    A key is the sum of the words' hashes, each times BASE to the power of its place. Words
    after the one left out move up by one place, which is a division by BASE, so prefix sums
    give all variants of a line in time linear in its words, however long it is.
    """
    for batch in batches:
        words = batch.column("words")
        hashes = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(hashes)) - starts[row]
        powers = np.cumprod(np.full(int(n.max(initial=0)) + 1, BASE, dtype=np.uint64))
        weighted = hashes * powers[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)])
        whole = sums[ends] - sums[starts]
        before = sums[:-1] - sums[starts][row]
        less = before + (whole[row] - before - weighted) * BASE_INVERSE
        owner = pa.array(np.concatenate([row, np.arange(len(n))]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("line_id").take(owner),
                batch.column("first").take(owner),
                pa.array(np.concatenate([at + 1, np.zeros(len(n), np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([less, whole]).view(np.int64)),
            ],
            names=["line_id", "first", "at", "key"],
        )


def within_one_edit(a: list, b: list) -> bool:
    """Whether two lists of words differ by at most one word put in, left out or replaced."""
    if len(a) == len(b):
        return sum(map(operator.ne, a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if len(long) > len(short) + 1:
        return False
    at = next((i for i, differs in enumerate(map(operator.ne, long, short)) if differs), len(short))
    return long[at + 1 :] == short[at:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (line_id, other) whose lines are within the edit bound."""
    for batch in batches:
        pairs = zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist())
        near = pa.array([within_one_edit(a.split(b" "), b.split(b" ")) for a, b in pairs], pa.bool_())
        yield batch.select(["line_id", "other"]).filter(near)


def earlier_lines(docs: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """line_id, first, keep: per different line its own first place and that of the line kept.

    ``keep`` is the first place of the earliest line within the edit bound, its own if none
    is earlier.
    """
    halves = [F.min(half).alias(half) for half in HALVES]  # the same in all equal lines
    distinct = settle(places.groupBy("line_id").agg(F.min("place").alias("first"), *halves))
    # A line goes by 64 bits here: should two lines share them, one more candidate is looked at.
    short = distinct.withColumn("short", F.xxhash64("line_id"))
    half = short.where(F.col(HALVES[0]).isNotNull()).select("short", F.explode(F.array(*HALVES)).alias("half"))
    shared = settle(half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"))
    named = settle(half.join(shared.hint("merge"), "half").select("short").distinct())
    able = settle(short.join(named, "short").select("line_id", "first"))
    candidates = _spelled(docs, able, key, text)
    hashed = candidates.select("line_id", "first", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("words"))
    emitted = settle(hashed.mapInArrow(_variant_keys, "line_id binary, first decimal(38,0), at int, key bigint"))
    again = settle(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    variants = settle(emitted.join(again, "key"))  # most keys are met once and lead nowhere
    less, whole = variants.where("at > 0"), variants.where("at = 0")
    by_place = settle(less.groupBy("key", "at").agg(F.min("first").alias("other")))
    replaced = less.join(by_place, ["key", "at"])
    shorter = whole.select("key", F.col("first").alias("other"))
    longer = by_place.groupBy("key").agg(F.min("other").alias("other"))
    found = (
        replaced.select("line_id", "first", "other")
        .unionByName(less.join(shorter, "key").select("line_id", "first", "other"))
        .unionByName(whole.join(longer, "key").select("line_id", "first", "other"))
        .where("other < first")
        .distinct()
    )
    mine = candidates.select("line_id", F.col("line").cast("binary").alias("mine"))
    theirs = candidates.select(F.col("first").alias("other"), F.col("line").cast("binary").alias("theirs"))
    pairs = found.join(mine, "line_id").join(theirs, "other").select("line_id", "other", "mine", "theirs")
    verified = pairs.mapInArrow(_verified, "line_id binary, other decimal(38,0)")
    near = verified.groupBy("line_id").agg(F.min("other").alias("keep"))
    return distinct.join(near, "line_id", "left").select("line_id", "first", F.coalesce("keep", "first").alias("keep"))


def line_decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept: one row per line that has a word.

    A line is dropped if an equal line, or one within the edit bound, comes earlier in the
    order of (doc_id, line_no); it points at the earliest such line. Lines are compared with
    white space evened out; a NULL text has none. Rows that repeat one doc_id share places,
    so their lines are kept or dropped together. An empty table gives an empty one.
    """
    places = settle(_lines(docs, key, text))
    joined = places.drop(*HALVES).join(settle(earlier_lines(docs, places, key, text)), "line_id")
    keep_doc, keep_line = _unplaced(F.col("keep"))
    return joined.select(
        "doc_id",
        F.col("line_no").cast("int").alias("line_no"),
        keep_doc.alias("keep_doc_id"),
        keep_line.alias("keep_line_no"),
        (F.col("keep") == F.col("place")).alias("kept"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without dropped lines; lines without a word stay as they are."""
    names = docs.columns
    dropped = (
        line_decisions(docs, key, text)
        .where("not kept")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_set("line_no").alias("__gone"))  # of one document
    )
    joined = docs.join(dropped, F.col(key).eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)).select(
        *[F.col(f"`{c}`") for c in names]
    )
