"""Balanced contiguous shards from prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import running_totals, text_of
from viewgrain.plans.settle import settle

SHARDS = 16


def shard(docs: DataFrame, n: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards that follow the order of doc_id.

    The size of a document is the UTF-8 bytes of its text (NULL: none) plus 1. Prefix sums
    over all documents, in the order of doc_id with NULL first, come from the totals of each
    partition; a document goes to the shard in whose equal part of all bytes its middle byte
    lies. So shards are runs of consecutive documents and differ by less than a document at
    each cut. One document of more than a shard's bytes leaves other shards short or empty.
    Rows that repeat are placed each; an empty table gives an empty one.
    """
    body = text_of(text)
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = settle(slim)
    placed = running_totals(
        rows, [], ["doc_id", "size", "text_crc32", "__row"], {"__bytes": F.col("size"), "__rows": F.lit(1)}
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total")).select("total").scalar()
    middle = F.col("__bytes") + F.expr("size div 2")
    at = placed.withColumn("shard", F.least(F.lit(n - 1), F.floor(middle.cast("decimal(30,0)") * n / total)).cast("int"))
    kept = settle(at)
    first = kept.groupBy(F.col("shard").alias("__s")).agg(F.min("__rows").alias("__first"))  # one row per shard
    joined = kept.join(F.broadcast(first), F.col("shard") == F.col("__s"))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("__rows") - F.col("__first")).alias("slot"))
