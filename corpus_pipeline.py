"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before it wrote and keeps, drops or repeats documents; the last
one packs them. ``run`` writes every stage as Parquet to the session's shared folder and reads
it back, so a lost executor costs one stage at most. What a stage settled on its way is deleted
once its result is written.

In every stage an empty table gives an empty one, a NULL text counts as empty, NULL ids and
sources are values like any other, rows that repeat are rows of their own, and further columns
are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewgrain.llm import exact, mixing, packing, quality, simhash
from viewgrain.llm.common import prepare
from viewgrain.plans.settle import drop_settled, settle, settled_path, settled_paths


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them.

    A NULL or empty text has too few words and goes; rows that repeat are judged each.
    """
    prepare(spark)
    return quality.cleaned(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id, NULL last.

    Of rows that repeat that id the first one read stays; a rerun keeps the same rows.
    """
    prepare(spark)
    return exact.deduplicated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the smallest doc_id, NULL last.

    Of rows that repeat that id the first one read stays; texts without a word are alike.
    """
    prepare(spark)
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times.

    A document without a word is never taken; rows that repeat share their copies evenly.
    """
    prepare(spark)
    return mixing.copied(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text is a piece of the end mark alone; rows that repeat are packed each.
    """
    prepare(spark)
    pieces = packing.tokenise(docs)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: SQL has no fingerprints, pivotal rounding or tokenizers; the tests hold the stages against
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, applied to the table ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = settled_paths(spark)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        drop_settled(spark, keep=[*before, settled_path(docs)])
    return docs
