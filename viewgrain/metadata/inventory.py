"""Complexity, summaries, duplicates, differences and rule checks of an inventory."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewgrain.metadata.formulas import classify_formula
from viewgrain.plans.keys import null_safe_join
from viewgrain.plans.settle import settle

# Points per counted thing, and the score up to which each label holds.
WEIGHTS = {
    "calc_count": 5,
    "lod_count": 15,
    "lod_channel_count": 5,
    "table_calc_count": 12,
    "filter_count": 2,
    "parameter_count": 3,
    "overlay_count": 5,
    "action_count": 3,
}
FIELD_WEIGHT, FIELD_CAP, SCORE_CAP = 2, 20, 100
HARD_VISUALS, HARD_VISUAL_POINTS, PAGES_POINTS = ["map", "geo", "gantt", "waterfall"], 20, 10
LABELS = [(15, "Simple"), (35, "Medium"), (65, "Complex")]
LAST_LABEL = "Very Complex"


def complexity(worksheets: DataFrame) -> DataFrame:
    """Add ``score`` (capped) and ``label`` (from the uncapped score); absent counts are 0."""

    def count_of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in worksheets.columns else F.lit(0)

    raw = F.least(count_of("field_count") * FIELD_WEIGHT, F.lit(FIELD_CAP))
    for name, weight in WEIGHTS.items():
        raw = raw + count_of(name) * weight
    if "visual_type" in worksheets.columns:
        hard = F.lower(F.coalesce("visual_type", F.lit(""))).rlike("|".join(HARD_VISUALS))
        raw = raw + F.when(hard, HARD_VISUAL_POINTS).otherwise(0)
    if "has_pages" in worksheets.columns:
        raw = raw + F.when(F.col("has_pages"), PAGES_POINTS).otherwise(0)
    label = F
    for limit, text in LABELS:
        label = label.when(F.col("__raw") <= limit, F.lit(text))
    return (
        worksheets.withColumn("__raw", raw)
        .withColumns(
            {"score": F.least("__raw", F.lit(SCORE_CAP)), "label": label.otherwise(LAST_LABEL)}
        )
        .drop("__raw")
    )


def migration_summary(
    worksheets: DataFrame, formulas: DataFrame, parameters: DataFrame | None = None
) -> DataFrame:
    """Counts by type per workbook; every input has a ``workbook`` column."""
    kind = classify_formula("formula")
    by_sheet = worksheets.groupBy("workbook").agg(F.count(F.lit(1)).alias("worksheets"))
    by_formula = formulas.groupBy("workbook").agg(
        F.count(F.lit(1)).alias("expressions"),
        F.count_if(kind == "STANDARD").alias("standard"),
        F.count_if(kind == "LOD").alias("lod"),
        F.count_if(kind == "TABLE_CALC").alias("table_calc"),
    )
    parts = [by_sheet, by_formula]
    if parameters is not None:
        parts.append(parameters.groupBy("workbook").agg(F.count(F.lit(1)).alias("parameters")))
    joined = reduce(lambda a, b: a.join(b, "workbook", "full"), parts)
    return joined.na.fill(0)


def dedupe_queries(datasets: DataFrame, widgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep one dataset per identical query and point the widgets at it.

    datasets(dataset, query), widgets(widget, dataset, ...). Returns the kept datasets and
    the widgets with identical ones dropped. Grouping is on a hash of the query text, so
    long texts are not shuffled, and a query that many datasets share is combined map-side.
    """
    hashed = datasets.select("dataset", F.sha2("query", 256).alias("__hash"))
    first = settle(hashed.groupBy("__hash").agg(F.min("dataset").alias("__kept")))
    remap = null_safe_join(hashed, first, ["__hash"]).select("dataset", "__kept")
    kept = datasets.join(first, datasets["dataset"] == first["__kept"], "left_semi")
    pointed = widgets.join(remap, "dataset", "left").withColumn(
        "dataset", F.coalesce("__kept", "dataset")
    )
    return kept, pointed.select(*widgets.columns).distinct()


def _row_hash(columns: Sequence[str]) -> Column:
    # NULLs do not change a running hash, so each column's NULL flag goes in as well.
    parts = [p for c in columns for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change) for the rows added, removed or modified between two snapshots.

    Only keys and a hash of the rest are shuffled; NULL is a key like any other.
    """
    keys = list(keys)
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]

    def hashed(df: DataFrame, name: str) -> DataFrame:
        # A column that one side lacks counts as NULL there.
        df = df.withColumns({c: F.lit(None) for c in rest if c not in df.columns})
        return df.select(*keys, _row_hash(rest).alias("__hash"), F.lit(name).alias("__side"))

    both = hashed(old, "old").unionByName(hashed(new, "new"))
    side = F.col("__side")
    states = both.groupBy(*keys).agg(
        F.count_if(side == "old").alias("__old"),
        F.count_if(side == "new").alias("__new"),
        F.sum(F.when(side == "old", F.col("__hash").cast("decimal(20,0)"))).alias("__old_hash"),
        F.sum(F.when(side == "new", F.col("__hash").cast("decimal(20,0)"))).alias("__new_hash"),
    )
    same = (F.col("__old") == F.col("__new")) & (F.col("__old_hash") == F.col("__new_hash"))
    change = (
        F.when(F.col("__old") == 0, "added").when(F.col("__new") == 0, "removed").when(~same, "modified")
    )
    return states.select(*keys, change.alias("change")).where("change IS NOT NULL")


#: Key buckets of a stored snapshot.
SNAPSHOT_BUCKETS = 256


def store_snapshot(df: DataFrame, keys: Sequence[str], path: str, buckets: int = SNAPSHOT_BUCKETS) -> None:
    """Write a snapshot in folders by key bucket, with a digest of each bucket beside it.

    A digest adds up hashes of rows, so it does not depend on their order.
    """
    keys = list(keys)
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    bucketed = df.withColumn(_BUCKET, F.pmod(hashed, F.lit(buckets)).cast("int"))
    # By ranges of (bucket, hash): a large bucket is written by several tasks, none by all.
    bucketed.repartitionByRange(_BUCKET, hashed).write.partitionBy(_BUCKET).parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    digest = F.sum(_row_hash(sorted(df.columns)).cast("decimal(20,0)")).cast("string")
    stored.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")).withColumn(
        "layout", F.lit(f"{buckets}: {', '.join(keys)}: {', '.join(sorted(df.columns))}")
    ).write.parquet(f"{path}/digests")


_BUCKET = "__bucket"


def stored_diff(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """``snapshot_diff`` of two stored snapshots that reads only the buckets that differ.

    Digests are compared first, a row per bucket; the unequal ones become a filter on the
    folders. Snapshots of other columns, keys or numbers of buckets are compared whole.
    """
    sides = [(spark.read.parquet(f"{p}/digests"), spark.read.parquet(f"{p}/rows")) for p in (old, new)]
    (a, old_rows), (b, new_rows) = sides
    layouts = a.select("layout").union(b.select("layout")).distinct()
    if layouts.count() > 1:
        return snapshot_diff(old_rows.drop(_BUCKET), new_rows.drop(_BUCKET), keys)
    other = b.withColumnsRenamed({"n": "m", "digest": "other"}).drop("layout")
    unequal = a.join(other, _BUCKET, "full").where("NOT (n <=> m AND digest <=> other)").select(_BUCKET)
    differing = sorted(r[0] for r in unequal.collect())  # as many as there are buckets, at most
    read = [rows.where(F.col(_BUCKET).isin(differing)).drop(_BUCKET) for rows in (old_rows, new_rows)]
    return snapshot_diff(*read, keys)


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item, a, b, equal): row counts, then order-free column and row fingerprints.

    Each side is one map-side-combined aggregate, whatever its size. A column that one side
    lacks has a row of its own that is not equal; the row fingerprint covers common columns.
    """
    names = [c for c in a.columns if c in b.columns]

    def prints(df: DataFrame) -> DataFrame:
        items = {f"column {c}": _row_hash([c]) for c in df.columns} | {"row": _row_hash(names)}
        one = df.agg(
            F.count(F.lit(1)).cast("string").alias("row count"),
            *[
                F.concat_ws(
                    ":", F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(20,0)")).cast("string")
                ).alias(n)
                for n, h in items.items()
            ],
        )
        return one.unpivot([], [F.col(f"`{c}`") for c in one.columns], "item", "print")

    left = prints(a).withColumnRenamed("print", "a")
    right = prints(b).withColumnRenamed("print", "b")
    return left.join(right, "item", "full").withColumn("equal", F.col("a").eqNullSafe(F.col("b")))


def reconcile_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys were removed, added or changed on the way from a to b."""
    return snapshot_diff(a, b, keys).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# Text that must not be left in a query, and chart types known to the target.
PSEUDO_FIELDS = r"(?i):?Measure\s+(Names|Values)|(Longitude|Latitude)\s*\(generated\)|\w+\s*\(bin\)|\bctd:"
INTERNAL_IDS = r"(?i)\[?(excel-direct|textscan)\.[^\]]*\]?"
UNRESOLVED_TABLES = r"(?i)(?:FROM|JOIN)\s+[`\"]?(Sheet\d*\$\d*|sample_table|Extract)[`\"]?(?:\s|$|,)"
WIDGET_TYPES = [
    "bar", "line", "area", "scatter", "pie", "counter", "table",
    "filter-multi-select", "filter-single-select", "filter-date-range-picker",
    "pivot", "heatmap",
]
GRID_COLUMNS = 6


def check_rules(datasets: DataFrame, widgets: DataFrame) -> DataFrame:
    """(rule, severity, key, message) for every broken rule.

    datasets(dataset, query), widgets(widget, dataset, type, x, width, height).
    """
    query, x, width = F.col("query"), F.col("x"), F.col("width")
    of_datasets = [
        ("empty_query", "ERROR", F.coalesce(query, F.lit("")) == "", "query is empty"),
        ("pseudo_field", "ERROR", query.rlike(PSEUDO_FIELDS), "query uses a pseudo-field"),
        ("internal_id", "ERROR", query.rlike(INTERNAL_IDS), "query uses an internal id"),
        ("unresolved_table", "ERROR", query.rlike(UNRESOLVED_TABLES), "table is not mapped"),
    ]
    of_widgets = [
        ("bounds_x", "ERROR", (x < 0) | (x > GRID_COLUMNS - 1), "x is outside the grid"),
        ("bounds_width", "ERROR", (width < 1) | (width > GRID_COLUMNS), "width is outside the grid"),
        ("bounds_right", "ERROR", x + width > GRID_COLUMNS, "widget passes the right edge"),
        ("bounds_height", "ERROR", F.col("height") < 1, "height is below 1"),
        ("widget_type", "WARNING", ~F.col("type").isin(WIDGET_TYPES), "chart type is not supported"),
    ]
    dangling = widgets.where(F.col("dataset").isNotNull()).join(
        datasets.select("dataset"), "dataset", "left_anti"
    )
    always = F.lit(True)
    parts = [
        _broken(datasets, "dataset", of_datasets),
        _broken(widgets, "widget", of_widgets),
        _broken(dangling, "widget", [("reference", "ERROR", always, "dataset does not exist")]),
        _broken(
            _doubled(datasets, "dataset"),
            "dataset",
            [("duplicate_dataset", "ERROR", always, "dataset name is used twice")],
        ),
        _broken(
            _doubled(widgets, "widget"),
            "widget",
            [("duplicate_widget", "ERROR", always, "widget id is used twice")],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _broken(df: DataFrame, key: str, rules: Sequence[tuple[str, str, Column, str]]) -> DataFrame:
    """A row per broken rule; all rules of a table are tested in one pass over it."""
    found = [
        F.when(
            condition,
            F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(text).alias("message")),
        )
        for rule, severity, condition, text in rules
    ]
    issues = F.explode(F.filter(F.array(*found), lambda issue: issue.isNotNull()))
    return df.select(F.col(key).alias("key"), issues.alias("issue")).select(
        "issue.rule", "issue.severity", "key", "issue.message"
    )


def _doubled(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)


def rule_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))
