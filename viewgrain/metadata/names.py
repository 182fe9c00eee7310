"""Matching table names by similarity.

The score is 1 for equal cleaned names, else 0.6 x sequence ratio + 0.4 x Jaccard overlap
of the words. Pairs are found by equi-joins that lose none of them:

* names that share a word meet on that word;
* names that share none need a ratio of at least ``min_conf / 0.6``. The ratio cannot exceed
  the Dice overlap of the characters (each counted with its repetitions), so such names
  share a character among the first few of a fixed order: the prefix filter of set
  similarity joins, applied per pair of lengths.

A bound from the same character counts then drops pairs before the ratio is computed. With
a low ``min_conf`` most names that share a frequent word do pass it; that many pairs really
are compared, and adaptive execution splits such a word over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.plans.keys import attach_constants
from viewgrain.plans.settle import settle

# Weights and labels of a score.
SEQUENCE_WEIGHT, WORD_WEIGHT = 0.6, 0.4
STRONG, PARTIAL = 0.9, 0.6
# Any fixed order gives right results; rare characters first make the joins selective.
_RARE_FIRST = "zqxjkvbwyfgpmhuldcosnrtaie0123456789 _"
_MARGIN = 1e-9


def clean_name(name: Column) -> Column:
    """Drop ``$...`` and ``!...``, turn other signs into spaces, trim, lower-case."""
    cut = F.regexp_replace(name, r"[$!].*$", "")
    spaced = F.regexp_replace(cut, r"[^a-zA-Z0-9_\s]", " ")
    return F.lower(F.regexp_replace(spaced, r"^\s+|\s+$", ""))


def words(clean: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(clean, r"[_\s]+"), ""))


def counted_characters(clean: Column) -> Column:
    """The characters as sortable numbers, a repetition being a number of its own."""

    def repeats(c: Column) -> Column:
        n = F.length(clean) - F.length(F.replace(clean, c, F.lit("")))
        listed = F.instr(F.lit(_RARE_FIRST), c)
        place = F.when(listed > 0, listed).otherwise(F.length(F.lit(_RARE_FIRST)) + 1 + F.ascii(c))
        # Later repetitions are rarer, so they come first.
        return F.transform(F.sequence(n, F.lit(1)), lambda i: place - i * 1000)

    distinct = F.array_distinct(F.split(clean, ""))
    return F.array_sort(F.flatten(F.transform(distinct, repeats)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def match_names(
    left: DataFrame, right: DataFrame, min_conf: float = 0.3, k: int = 5
) -> DataFrame:
    """(left_name, right_name, score, label): the best ``k`` right names of each left name.

    Inputs have one column of names; equal scores are ordered by the right name. Names
    that clean to the same text are compared once.
    """
    lefts = left.select(F.col(left.columns[0]).alias("left_name")).distinct()
    rights = right.select(F.col(right.columns[0]).alias("right_name")).distinct()
    lefts = lefts.where("left_name IS NOT NULL").withColumn("a", clean_name(F.col("left_name")))
    rights = rights.where("right_name IS NOT NULL").withColumn("b", clean_name(F.col("right_name")))
    # Only the first k names that clean alike can be among the best k.
    rights = _best(rights, "b", [F.col("right_name")], k)
    lefts, rights = settle(lefts), settle(rights)
    a = settle(_described(lefts.select("a").distinct(), "a"))
    b = settle(_described(rights.select("b").distinct(), "b"))

    exact = a.join(b, a["a"] == b["b"]).select("a", "b", F.lit(1.0).alias("score"))
    similar = _pairs_by_word(a, b).union(_pairs_by_characters(a, b, min_conf / SEQUENCE_WEIGHT))
    ratio_at_most = 2.0 * _common("chars") / (F.length("a") + F.length("b"))
    bound = SEQUENCE_WEIGHT * ratio_at_most + WORD_WEIGHT * _word_overlap()
    likely = similar.where(F.col("a") != F.col("b")).where(bound >= min_conf - _MARGIN)
    # The ratio is the costly step: pairs are dealt evenly, whatever names they came from.
    spark = left.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism
    )
    likely = likely.select("a", "b", "a_words", "b_words").repartition(tasks, "a", "b")
    score = SEQUENCE_WEIGHT * sequence_ratio("a", "b") + WORD_WEIGHT * _word_overlap()
    scored = likely.withColumn("score", score).where(F.col("score") >= min_conf)
    found = scored.select("a", "b", "score").union(exact)
    rounded = found.withColumn("score", F.round("score", 4))
    named = rounded.join(rights, "b").select("a", "right_name", "score")
    best = _best(named, "a", [F.col("score").desc(), F.col("right_name")], k)
    label = F.when(F.col("score") >= STRONG, "strong").when(F.col("score") >= PARTIAL, "partial")
    return lefts.join(best, "a").select(
        "left_name", "right_name", "score", label.otherwise("weak").alias("label")
    )


def _best(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    # A filter on row_number is pushed below the shuffle: each task sends k rows per name.
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def _described(names: DataFrame, name: str) -> DataFrame:
    return names.withColumns(
        {
            f"{name}_words": words(F.col(name)),
            f"{name}_chars": counted_characters(F.col(name)),
            f"{name}_len": F.length(name),
        }
    )


def _common(what: str) -> Column:
    return F.size(F.array_intersect(f"a_{what}", f"b_{what}"))


def _first_common(what: str) -> Column:
    return F.get(F.array_intersect(f"a_{what}", f"b_{what}"), F.lit(0))


def _word_overlap() -> Column:
    either = F.size(F.array_union("a_words", "b_words"))
    return F.coalesce(F.try_divide(_common("words").cast("double"), either), F.lit(0.0))


_PAIR = ["a", "b", "a_words", "b_words", "a_chars", "b_chars"]


def _pairs_by_word(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with a word in common, each at the first of its common words only."""
    left = a.withColumn("word", F.explode("a_words"))
    right = b.withColumn("word", F.explode("b_words"))
    return left.join(right, "word").where(_first_common("words") == F.col("word")).select(*_PAIR)


def _pairs_by_characters(a: DataFrame, b: DataFrame, need: float) -> DataFrame:
    """Pairs without a common word whose characters overlap enough for a ratio of ``need``,
    each at the first of its common characters only."""
    if need <= 0:
        raise ValueError("min_conf must be positive")
    left = _prefixes(a, "a", need, "b_len", b)
    right = _prefixes(b, "b", need, "a_len", a)
    met = left.join(right, ["token", "a_len", "b_len"])
    met = met.where(~F.arrays_overlap("a_words", "b_words"))
    return met.where(_first_common("chars") == F.col("token")).select(*_PAIR)


def _prefixes(names: DataFrame, name: str, need: float, other: str, others: DataFrame) -> DataFrame:
    """A row per length a partner may have and per character token of which a pair with a
    Dice overlap of ``need`` must share one."""
    own, partner = F.col(f"{name}_len"), F.col(other)
    # The distinct lengths of names are few: no more than the longest name is long.
    lengths = others.agg(F.collect_set(other).alias("__lengths"))
    sized = attach_constants(names, lengths).withColumn(other, F.explode("__lengths"))
    common = F.ceil((own + partner) * need / 2 - _MARGIN)
    possible = sized.where((own > 0) & (partner > 0) & (common <= F.least(own, partner)))
    prefix = F.slice(f"{name}_chars", F.lit(1), (own - common + 1).cast("int"))
    return possible.drop("__lengths").withColumn("token", F.explode(prefix))
