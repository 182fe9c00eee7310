"""Line-first quality rules, in DataFrame functions only.

Each line is judged alone: its punctuation, whether it looks like navigation, whether it is
boilerplate. Failing lines go. A document that loses too much of its text, or fails the base
limits, is rejected; the others keep what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import SPACE, text_of

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Most of a line's characters that may be marks, and of a document's that may be lost.
MOST_MARKS_PERCENT = 25
MOST_LOST_PERCENT = 40
#: A line of so many separators, with no more characters to each on average, is a menu.
LEAST_SEPARATORS, MENU_ENTRY_CHARS = 3, 40
#: Longest line, in characters, that a boilerplate phrase condemns.
BOILERPLATE_CHARS = 160

# Marks that prose holds few of, separators of menus, phrases of boilerplate.
MARKS = r"[#*$%&|<>!?=_~^@\\{}\[\]+/]"
SEPARATOR = r" [|»›•·] "
PHRASES = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "javascript is disabled",
    "licensed under",
    "released under the",
    "subscribe to our",
    "sign up for our",
    "click here",
    "read more",
    "share this",
    "follow us on",
    "skip to content",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first one included.

    Windows are compared by hash, in order: a sorted list has equal ones side by side. The
    words themselves are compared before a window counts. Only texts that have equal hashes
    at all are sorted.
    """

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def same(p: Column, q: Column) -> Column:
        return F.coalesce(
            (p["h"] == q["h"])
            & (F.get(words, p["i"]) == F.get(words, q["i"]))
            & (F.get(words, p["i"] + 1) == F.get(words, q["i"] + 1))
            & (F.get(words, p["i"] + 2) == F.get(words, q["i"] + 2)),
            F.lit(False),
        )

    def covered(starts: Column) -> Column:
        """Words in windows that start at these places, given in order."""
        return F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(
            placed,
            lambda s: F.filter(s, lambda p, k: same(p, F.get(s, k - 1)) | same(p, F.get(s, k + 1))),
        )
        starts = F.sort_array(F.transform(found, lambda p: p["i"]))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(starts)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def bad_line(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    solid = F.length(F.regexp_replace(line, f"{SPACE}+", ""))
    marks = F.regexp_count(line, F.lit(MARKS))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    menu = (separators >= LEAST_SEPARATORS) & (F.length(line) <= (separators + 1) * MENU_ENTRY_CHARS)

    def has_phrase(small: Column) -> Column:
        return reduce(Column.__or__, [F.contains(small, F.lit(p)) for p in PHRASES])

    return (
        (marks * 100 > solid * MOST_MARKS_PERCENT)
        | menu
        | ((F.length(line) <= BOILERPLATE_CHARS) & let(F.lower(line), has_phrase))
    )


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` under ``doc``, and doc_id, the measures, clean_text and kept.

    A NULL text has no words and is rejected for it, as an empty one is. Lines without a word
    are neither judged nor lost. The phrases of boilerplate are English ones, so lines in other
    languages are judged by their marks and separators alone. Rows that repeat are judged each; an empty table gives an
    empty one. The input's columns are kept in one struct, so names of its own cannot clash.
    """
    body = text_of(text)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("doc_id"), body.alias("text"))

    def decided(line: Column) -> Column:
        """The line, whether it has a word, and whether it fails: each line is judged once."""
        has_word = F.regexp_like(line, F.lit(f"[^{SPACE[1:-1]}]"))
        return F.struct(line.alias("line"), has_word.alias("worded"), (has_word & bad_line(line)).alias("bad"))

    split = named.select(
        *["doc", "doc_id", "text", words_of(F.col("text")).alias("words")], F.transform(F.split("text", "\n"), decided).alias("lines")
    )
    parted = split.select(
        "*",
        F.transform(F.filter("lines", lambda x: x["worded"]), lambda x: x["line"]).alias("worded"),
        F.transform(F.filter("lines", lambda x: x["bad"]), lambda x: x["line"]).alias("bad"),
    )
    left = F.array_join(F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    solid = lambda c: F.length(F.regexp_replace(c, f"{SPACE}+", "")).cast("long")
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    # An explode of one element: a filter on the measures must not be pushed below them, where
    # it would repeat their expressions in full for every place that refers to a word.
    measured = parted.select(
        "doc",
        "doc_id",
        F.explode(
            F.array(
                F.struct(
                    F.size("words").cast("long").alias("n_words"),
                    solid(F.col("text")).alias("word_chars"),
                    symbols.cast("long").alias("n_symbols"),
                    (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
                    repeated_words(F.col("words")).alias("n_repeat_words"),
                    solid(F.array_join("bad", "")).alias("lost_chars"),
                    F.when(F.size("bad") == 0, F.col("text")).otherwise(left).alias("clean_text"),
                )
            )
        ).alias("m"),
    ).select("doc", "doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    too_much = F.col("lost_chars") * 100 > F.col("word_chars") * MOST_LOST_PERCENT
    return measured.select(
        *["doc", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars"],
        failed.alias("base_failed"),
        (~failed & ~too_much).alias("kept"),
        "clean_text",
    )


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, without their bad lines; ``n_chars`` follows if there is one."""
    left = judged(docs, key, text).where("kept")
    changed = {text: F.col("clean_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
