"""Every registered query: a function over the given tables and, where SQL can say the
same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from viewgrain.plans.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_AREAS = (
    "worksheets",
    "filtering",
    "levels",
    "calculations",
    "aggregation",
    "reshaping",
    "scalars",
    "charts",
    "inventory",
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def tuned(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        _QUERIES[fn.__name__] = tuned
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _load() -> None:
    for area in _AREAS:
        import_module(f"viewgrain.catalogue.{area}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
