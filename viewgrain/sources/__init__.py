"""Reading tables and files, naming columns, and the catalog as a table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("catalog_name", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("position", T.IntegerType()),
    ]
)

#: A column in the description of a table: name, type, nullable.
_COLUMN_LINE = r"(?m)^ \|-- (.*): ([^:]+) \(nullable = (true|false)\)$"
_SHORT_TYPES = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint"}

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ("information_schema", "sys")


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table by name, or a Parquet file or folder by path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def read_files(
    spark: SparkSession,
    path: str,
    format: str,
    header: bool = True,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """csv, tsv, json or parquet files. A given schema saves the inference pass over the data."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if format in ("csv", "tsv"):
        reader = reader.option("header", header).option("inferSchema", schema is None)
        return reader.option("sep", "\t" if format == "tsv" else ",").csv(path)
    if format in ("json", "parquet"):
        return reader.format(format).load(path)
    raise ValueError(f"unsupported format {format!r}")


def create_table_as(
    df: DataFrame, name: str, if_not_exists: bool = True, partition_by: tuple[str, ...] = ()
) -> None:
    """Save as a managed table; an existing one is left alone unless asked otherwise."""
    writer = df.write.mode("ignore" if if_not_exists else "overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def custom_query(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, **frames: DataFrame):
    """Custom SQL as a source: ``:name`` parameters are bound, ``{frame}`` names a DataFrame."""
    return spark.sql(sql, args=dict(args or {}), **frames)


def safe_name(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", name)).strip("_") or name


def safe_names(df: DataFrame) -> DataFrame:
    """Columns renamed to letters, digits and underscores; a repeated name gets ``_2``, ``_3``."""
    taken: set[str] = set()
    names = []
    for column in df.columns:
        base = candidate = safe_name(column)
        n = 1
        while candidate.lower() in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate.lower())
        names.append(candidate)
    return df.toDF(*names)


def catalog_columns(spark: SparkSession, catalogs: Iterable[str] | None = None) -> DataFrame:
    """One row per column of every user table: of all catalogs the session lists, or of some.

    A schema is asked once for all its tables; their descriptions are taken apart by Spark.
    Temporary views come without catalog and schema. A nested type is given by its kind.
    """
    listed = [c.name for c in spark.catalog.listCatalogs()] if catalogs is None else list(catalogs)
    parts = []
    for catalog in listed:
        for schema in [r[0] for r in spark.sql(f"SHOW SCHEMAS IN {_quoted(catalog)}").collect()]:
            if schema.lower() not in SYSTEM_SCHEMAS:
                tables = spark.sql(f"SHOW TABLE EXTENDED IN {_quoted(catalog)}.{_quoted(schema)} LIKE '*'")
                parts.append(tables.select(F.lit(catalog).alias("catalog"), F.lit(schema).alias("schema"), "*"))
    if not parts:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    tables = reduce(DataFrame.unionByName, parts)
    own = lambda c: F.when(~F.col("isTemporary"), F.col(c))
    columns = F.transform(
        F.regexp_extract_all("information", F.lit(_COLUMN_LINE), 0),
        lambda c, i: F.struct(
            F.regexp_extract(c, _COLUMN_LINE, 1).alias("column_name"),
            F.regexp_extract(c, _COLUMN_LINE, 2).alias("data_type"),
            (F.regexp_extract(c, _COLUMN_LINE, 3) == "true").alias("nullable"),
            (i + 1).alias("position"),
        ),
    )
    rows = tables.select(
        own("catalog").alias("catalog_name"), own("schema").alias("schema_name"), F.col("tableName").alias("table_name"),
        F.explode(columns).alias("c"),
    ).select("catalog_name", "schema_name", "table_name", "c.*").distinct()  # every schema lists the temporary views
    short = F.create_map(*[F.lit(x) for pair in _SHORT_TYPES.items() for x in pair])
    return rows.withColumn("data_type", F.coalesce(F.try_element_at(short, F.col("data_type")), "data_type")).select(*CATALOG_SCHEMA.names)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def frame_columns(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The same rows for DataFrames that no catalog knows."""
    rows = [
        (None, None, name, f.name, f.dataType.simpleString(), f.nullable, i)
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def search_tables(columns: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Tables whose full name contains ``text``, whatever the case: all, or the first ``limit``."""
    place = ["catalog_name", "schema_name", "table_name"]
    full = F.lower(F.concat_ws(".", *place))
    found = columns.where(full.contains(text.lower())).select(*place).distinct().orderBy(*place)
    return found if limit is None else found.limit(limit)


def find_column(columns: DataFrame, name: str) -> DataFrame:
    """Every column with this name, whatever the case."""
    return columns.where(F.lower("column_name") == name.lower())


def export_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header, one file per partition."""
    df.write.option("header", True).csv(path)
