"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import viewgrain
from viewgrain.plans.session import tune
from viewgrain.plans.settle import settle

#: Regular expression class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that one Arrow batch carries to a Python worker, so that long texts never
#: add up to more than a worker holds.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators count on: adaptive skew joins and bounded Arrow batches.

    Python workers also get the folder this package was imported from on their path; where
    the package is installed or shipped with the job, that changes nothing.
    """
    root = str(Path(viewgrain.__file__).resolve().parent.parent)
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spare(names: list[str], name: str) -> str:
    """``name``, or a longer form of it that no column has."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str = "row") -> DataFrame:
    """A settled copy with a number of its own on every row.

    The number comes from the partition and the place in it, so it may only be used once
    the rows are written: a frame evaluated twice could number them differently.
    """
    return settle(df.withColumn(name, F.monotonically_increasing_id()))


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, Column],
) -> DataFrame:
    """Add to each row the totals over the rows of its group that come before it.

    Prefix sums in two steps, so that neither a hot group nor a table-wide one meets in one
    task: the rows are range-partitioned on (group, order) and written once; each partition
    gives one row of totals per group; those rows, as few as there are partitions in a
    group, are summed up over the earlier partitions and added to the sums inside each.
    ``order`` should be total; rows that tie on all of it are identical to the result.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    cut = settle(df.repartitionByRange(*keys).withColumn("__block", F.spark_partition_id()))
    inside = W.partitionBy("__block", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    earlier_rows = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = cut.withColumns(
        {n: F.coalesce(F.sum(v).over(earlier_rows), F.lit(0)).cast("long") for n, v in totals.items()}
    )
    per_block = cut.groupBy("__block", *group).agg(*[F.sum(v).alias(f"__{n}") for n, v in totals.items()])
    earlier_blocks = W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    base = per_block.select(
        F.col("__block").alias("__b"),
        *[F.col(c).alias(f"__g_{c}") for c in group],
        *[F.coalesce(F.sum(f"__{n}").over(earlier_blocks), F.lit(0)).cast("long").alias(f"__{n}") for n in totals],
    )
    on = F.col("__block") == F.col("__b")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    joined = rows.join(base, on)
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in totals}).select(*df.columns, *totals)
