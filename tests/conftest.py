from __future__ import annotations

import os
import sys
from contextlib import contextmanager

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("viewgrain-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def large(spark):
    """Size limits so low that every operator goes the way it goes on large inputs."""

    @contextmanager
    def limits(block_rows: int = 7):
        spark.conf.set("spark.viewgrain.settleBytes", "0")
        spark.conf.set("spark.viewgrain.blockRows", str(block_rows))
        try:
            yield
        finally:
            spark.conf.unset("spark.viewgrain.settleBytes")
            spark.conf.unset("spark.viewgrain.blockRows")

    return limits


def rows(df) -> list[tuple]:
    """Rows as plain tuples in a fixed order, doubles rounded."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
