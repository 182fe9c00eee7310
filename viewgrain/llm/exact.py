"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut into chunks at places its content decides: the first sentence end
past ``LEAST`` characters, or ``MOST`` characters where there is none. Each chunk gets an
identifier, and the identifiers are verified: every distinct chunk is moved once, to see that
no two share one. From then on a document is its recipe, the ordered list of the identifiers
of its chunks: about one hundredth of its text. Equal recipes are equal texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import spare, text_of, with_row_key
from viewgrain.plans.settle import settle

LEAST, MOST = 512, 4096
_CHUNK = rf"(?s).{{{LEAST},{MOST}}}?[.!?] |.{{1,{MOST}}}"

Identifier = Callable[[Column], Sequence[Column]]


def _identifiers() -> list[Identifier]:
    """Ways to name a chunk by two 64-bit numbers; the next is tried if one is found to clash."""
    return [
        lambda chunk, salt=salt: (F.xxhash64(chunk), F.xxhash64(F.lit(salt), chunk)) for salt in (11, 12, 13)
    ]


def normalised(text: Column) -> Column:
    """Each run of white space as one space; runs that are one space already are left alone."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunks(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(_CHUNK), 0)


def clashes(texts: DataFrame, identify: Identifier) -> DataFrame:
    """Identifiers that two different chunks of the column ``normal`` share."""
    chunk = texts.select(F.explode(chunks(F.col("normal"))).alias("chunk"))
    named = chunk.select(*[c.alias(f"i{n}") for n, c in enumerate(identify(F.col("chunk")))], "chunk")
    keys = [c for c in named.columns if c != "chunk"]
    return named.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def verified(texts: DataFrame, ways: Sequence[Identifier] | None = None) -> Identifier:
    """The first way of naming chunks under which no two chunks share a name."""
    for identify in ways or _identifiers():
        if clashes(texts, identify).isEmpty():
            return identify
    raise RuntimeError("chunks clash under every way of naming them")


def recipe_of(texts: DataFrame, ways: Sequence[Identifier] | None = None) -> Column:
    """The verified identifiers of the chunks of the column ``normal``, in order."""
    identify = verified(texts, ways)
    return F.flatten(F.transform(chunks(F.col("normal")), lambda c: F.array(*identify(c))))


def duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ways: Sequence[Identifier] | None = None
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    Texts are equal if they are so after ``normalised``; NULL is the empty text, and empty
    texts equal each other. The row with the smallest doc_id of a group stays; of rows that
    repeat that doc_id, one. A NULL doc_id stays only where the group has no other. An empty
    table gives an empty one; other columns are not read.
    """
    texts = docs.select(F.col(key).alias("doc_id"), normalised(text_of(text)).alias("normal"))
    rows = with_row_key(
        texts.select("doc_id", recipe_of(texts, ways).alias("recipe"), F.sha2(F.encode("normal", "UTF-8"), 256).alias("text_sha256"))
    )
    grouped = rows.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
    )
    # Settled, so that both sides of the join are shuffled and a hot group can be split.
    joined = rows.join(settle(grouped), "recipe")
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class of equal texts.

    It is the one with the smallest doc_id, NULL last, and of rows that repeat that id the first
    as they were read, so a rerun over the same files keeps the same rows. NULL is the empty
    text; an empty table gives an empty one. Rows get a key, recipes are grouped, and the keys of
    the rows that go are taken out: no text is moved but for the chunks that are verified.
    """
    names = docs.columns
    row = spare(names, "row")
    keyed = with_row_key(docs, row)
    texts = keyed.select(F.col(row).alias("row"), F.col(f"`{key}`").alias("doc_id"), normalised(text_of(text)).alias("normal"))
    recipes = settle(texts.select("row", "doc_id", recipe_of(texts).alias("recipe")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    several = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), first.alias("keep_row")).where("n > 1")
    # Settled, so that a side known to be small needs no shuffle and a large one can be split.
    gone = recipes.join(settle(several), "recipe").where("row <> keep_row")
    removed = settle(gone.select(F.col("row").alias(row)))
    return keyed.join(removed, row, "left_anti").select(*[F.col(f"`{c}`") for c in names])
