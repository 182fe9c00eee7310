"""Key inference over column metadata, and its check against the data."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.plans.settle import settle

PAIR = ["from_table", "from_column", "to_table", "to_column"]
# Confidence per kind of evidence.
CONFIDENCE = {
    "declared": 1.0,
    "join": 0.9,
    "relationship": 0.85,
    "same_key": 0.7,
    "table_id": 0.6,
}


def infer_keys(
    columns: DataFrame,
    declared: DataFrame | None = None,
    joins: DataFrame | None = None,
    relationships: DataFrame | None = None,
) -> DataFrame:
    """(from_table, from_column, to_table, to_column, kind, confidence), best kind per pair.

    columns(table_name, column_name, is_pk, position); the other inputs are pairs as named
    in ``PAIR``. A column ``{t}_id`` refers to table t, else its singular, else its plural;
    any other column refers to each primary key of the same name in another table.
    """
    # Read several times below, and often the result of a longer query.
    columns = settle(columns.select("table_name", "column_name", "is_pk", "position"))
    found = {
        "declared": declared,
        "join": joins,
        "relationship": relationships,
        "same_key": _by_key_name(columns),
        "table_id": _by_table_name(columns),
    }
    parts = [
        df.select(*PAIR, F.lit(CONFIDENCE[kind]).alias("confidence"))
        for kind, df in found.items()
        if df is not None
    ]
    merged = reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(
        F.max("confidence").alias("confidence")
    )
    kind = F
    for name, confidence in CONFIDENCE.items():
        kind = kind.when(F.col("confidence") == confidence, F.lit(name))
    return merged.select(*PAIR, kind.alias("kind"), "confidence")


def _by_table_name(columns: DataFrame) -> DataFrame:
    name = F.lower("column_name")
    wanted = columns.where(name.endswith("_id")).select(
        F.col("table_name").alias("from_table"),
        F.col("column_name").alias("from_column"),
        F.expr("left(lower(column_name), length(column_name) - 3)").alias("ref"),
    )
    # The ways to refer to a table: its name, its plural, and its singular, in that order.
    # They are spelled out per table, so each column needs one lookup. Of tables named alike
    # but for case, the first by name is taken.
    table = F.col("to_lower")
    singular = F.when(table.endswith("s"), F.expr("left(to_lower, length(to_lower) - 1)"))
    forms = [table, F.concat(table, F.lit("s")), singular]
    spelled = F.array(*[F.struct(F.lit(i).alias("turn"), f.alias("ref")) for i, f in enumerate(forms)])
    target = F.struct("to_table", "id_column", "own_column", "first_key")
    named = _target_columns(columns).withColumn("form", F.explode(spelled)).where("form.ref IS NOT NULL")
    first = named.groupBy(F.col("form.ref").alias("ref")).agg(F.min_by(target, F.struct("form.turn", "to_table")).alias("t"))
    referring = wanted.join(first, "ref").select("from_table", "from_column", "t.*")
    referring = referring.where("to_table <> from_table")
    same = columns.select(
        F.col("table_name").alias("to_table"), name.alias("__same"), F.col("column_name").alias("same_column")
    )
    on = [F.lower("from_column") == same["__same"], referring["to_table"] == same["to_table"]]
    column = F.coalesce("id_column", "own_column", "same_column", "first_key")
    return (
        referring.join(same, on, "left")
        .select("from_table", "from_column", referring["to_table"], column.alias("to_column"))
        .where("to_column IS NOT NULL")
    )


def _target_columns(columns: DataFrame) -> DataFrame:
    """What a reference to each table may point at, apart from a column of the same name."""
    name = F.lower("column_name")
    own = F.concat(F.lower("table_name"), F.lit("_id"))
    return columns.groupBy("table_name").agg(
        F.max(F.when(name == "id", F.col("column_name"))).alias("id_column"),
        F.max(F.when(name == own, F.col("column_name"))).alias("own_column"),
        F.min_by("column_name", F.when(F.col("is_pk"), F.col("position"))).alias("first_key"),
    ).select(
        F.col("table_name").alias("to_table"),
        F.lower("table_name").alias("to_lower"),
        "id_column",
        "own_column",
        "first_key",
    )


def _by_key_name(columns: DataFrame) -> DataFrame:
    name = F.lower("column_name")
    plain = columns.where(~F.col("is_pk") & (name != "id") & ~name.endswith("_id")).select(
        F.col("table_name").alias("from_table"),
        F.col("column_name").alias("from_column"),
        name.alias("key_name"),
    )
    keys = columns.where("is_pk").select(
        F.col("table_name").alias("to_table"),
        F.col("column_name").alias("to_column"),
        name.alias("key_name"),
    )
    return plain.join(keys, "key_name").where("from_table <> to_table").select(*PAIR)


def validate_key(child: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """One row that says how well ``{child column: parent column}`` holds in the data.

    Both sides are counted per key before they meet, so a hot key is one row of the join.
    """
    names = [f"k{i}" for i in range(len(keys))]
    given = reduce(Column.__and__, [F.col(n).isNotNull() for n in names])

    def per_key(df: DataFrame, cols: list[str], count: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])
        return named.where(given).groupBy(*names).agg(F.count(F.lit(1)).alias(count))

    met = per_key(child, list(keys), "child_n").join(
        per_key(parent, list(keys.values()), "parent_n"), names, "full"
    )
    child_n, parent_n = F.col("child_n"), F.col("parent_n")
    total = F.coalesce(F.sum(child_n), F.lit(0))
    orphaned = F.coalesce(F.sum(F.when(parent_n.isNull(), child_n)), F.lit(0))
    return met.agg(
        total.alias("child_rows"),
        orphaned.alias("orphan_rows"),
        F.count_if(child_n.isNotNull() & parent_n.isNull()).alias("orphan_keys"),
        F.coalesce(F.count_if(parent_n > 1), F.lit(0)).alias("duplicate_parent_keys"),
        F.try_divide((total - orphaned).cast("double"), total.cast("double")).alias("inclusion"),
    )


def schema_mismatches(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Fields (physical_name, caption) of which no column has either name, whatever the case."""
    known = columns.select(F.lower("column_name").alias("__name"))
    by_name = fields.join(known, F.lower("physical_name") == known["__name"], "left_anti")
    return by_name.join(known, F.lower("caption") == known["__name"], "left_anti")
