"""Session settings the operators count on for skewed keys."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits a hot join key; forced, it does so even where a following
#: aggregation would have reused the join's partitioning.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session; all of them may change while it runs."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
