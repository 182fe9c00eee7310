"""Writing an intermediate result once, so that its true size is known.

A settled frame is a Parquet table in the folder that ``spark.checkpoint.dir`` names.
It cuts the lineage, survives the loss of executors, gives every reader the same rows
(two evaluations of a floating-point sum may differ in the last bit), and lets the
planner choose a broadcast join from real file sizes instead of a guess.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Above this estimated size an intermediate result is settled before it is used again.
SETTLE_BYTES = "spark.viewgrain.settleBytes"
#: Most rows one task may be asked to put in order or hold as one group.
BLOCK_ROWS = "spark.viewgrain.blockRows"

_DEFAULT_SETTLE_BYTES = 16 * 1024 * 1024
_DEFAULT_BLOCK_ROWS = 1_000_000

_MARK = "_viewgrain_settled"
_local_folders: dict[str, str] = {}
_settled: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for settled tables: the cluster's own, or a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="viewgrain-")
    return _local_folders[app]


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS, str(_DEFAULT_BLOCK_ROWS)))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back.

    A frame that is such a table already is returned as it is.
    """
    if df.__dict__.get(_MARK):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/viewgrain/{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    kept = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    kept.__dict__[_MARK] = path
    return kept


def settled_paths(spark: SparkSession) -> list[str]:
    """The tables this application has settled and not deleted, in order."""
    return list(_settled.get(spark.sparkContext.applicationId, []))


def settled_path(df: DataFrame) -> str | None:
    """Where a settled frame is stored; None for any other frame."""
    return df.__dict__.get(_MARK)


def drop_settled(spark: SparkSession, keep: Iterable[str] = ()) -> int:
    """Delete the tables this application has settled, but for those to keep.

    Call it when their readers are done, and not while another thread settles tables.
    """
    keep = set(keep)
    all_paths = settled_paths(spark)
    paths = [path for path in all_paths if path not in keep]
    _settled[spark.sparkContext.applicationId] = [path for path in all_paths if path in keep]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def is_small(df: DataFrame) -> bool:
    """Whether the planner's size estimate, the figure Spark itself picks joins by, is low.

    The estimate knows file sizes and multiplies the sides of a join, but takes an explode
    for one row each, so a plan with one is never called small. A plan that is not small
    is settled and then judged by its true row count.
    """
    limit = int(df.sparkSession.conf.get(SETTLE_BYTES, str(_DEFAULT_SETTLE_BYTES)))
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) <= limit and "Generate " not in plan.toString()
