"""Default aggregation of a field from its name, type and role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns per kind of field, all matched without regard to case.
IDENTIFIER_PATTERNS = [
    r"(?:^|[_\s])id$",
    r"^id(?:[_\s]|$)",
    r"(?:^|[_\s])key$",
    r"(?:^|[_\s])code$",
    r"(?:^|[_\s])number$",
    r"(?:^|[_\s])num$",
    r"(?:^|[_\s])no$",
    r"(?:^|[_\s])uuid$",
    r"(?:^|[_\s])guid$",
    r"^pk[_\s]",
    r"^fk[_\s]",
    r"^sk[_\s]",
    r"(?:^|[_\s])insid$",
    r"(?:^|[_\s])incid$",
    r"(?:^|[_\s])sku$",
    r"(?:^|[_\s])ssn$",
    r"(?:^|[_\s])ein$",
    r"(?:^|[_\s])zip(?:code)?$",
    r"(?:^|[_\s])postal",
    r"(?:^|[_\s])phone",
    r"(?:^|[_\s])email",
    r"(?:^|[_\s])account",
    r"(?:^|[_\s])index$",
    r"(?:^|[_\s])row[_\s]?(?:num|id|number)$",
]
RATIO_PATTERNS = [
    r"ratio",
    r"percent(?:age)?",
    r"(?:^|[_\s])pct(?:[_\s]|$)",
    r"(?:^|[_\s])rate(?:[_\s]|$)",
    r"(?:^|[_\s])margin(?:[_\s]|$)",
    r"(?:^|[_\s])yield(?:[_\s]|$)",
    r"(?:^|[_\s])share(?:[_\s]|$)",
    r"(?:^|[_\s])proportion",
    r"(?:^|[_\s])efficiency",
    r"(?:^|[_\s])utilization",
    r"(?:^|[_\s])conversion",
    r"(?:^|[_\s])per[_\s]",
]
AVERAGE_PATTERNS = [
    r"^avg[_\s]",
    r"^average[_\s]",
    r"(?:^|[_\s])avg$",
    r"(?:^|[_\s])average$",
    r"(?:^|[_\s])mean(?:[_\s]|$)",
    r"(?:^|[_\s])median(?:[_\s]|$)",
]
PRE_AGGREGATED_PATTERNS = [
    r"^total[_\s]",
    r"(?:^|[_\s])total$",
    r"^sum[_\s]",
    r"(?:^|[_\s])sum$",
    r"^cumulative[_\s]",
    r"^running[_\s]",
    r"^grand[_\s]?total",
]
DATE_PATTERNS = [
    r"(?:^|[_\s])date(?:[_\s]|$)",
    r"(?:^|[_\s])datetime(?:[_\s]|$)",
    r"(?:^|[_\s])timestamp(?:[_\s]|$)",
    r"(?:^|[_\s])time(?:[_\s]|$)",
    r"(?:^|[_\s])year(?:[_\s]|$)",
    r"(?:^|[_\s])month(?:[_\s]|$)",
    r"(?:^|[_\s])day(?:[_\s]|$)",
    r"(?:^|[_\s])quarter(?:[_\s]|$)",
    r"(?:^|[_\s])week(?:[_\s]|$)",
    r"(?:^|[_\s])created[_\s]?(?:at|on|date)?$",
    r"(?:^|[_\s])updated[_\s]?(?:at|on|date)?$",
    r"(?:^|[_\s])modified[_\s]?(?:at|on|date)?$",
    r"(?:^|[_\s])birthdate$",
    r"(?:^|[_\s])dob$",
    r"(?:^|[_\s])start[_\s]?date$",
    r"(?:^|[_\s])end[_\s]?date$",
]
# Patterns of names that mark a label or a category.
TEXT_PATTERNS = [
    r"(?:^|[_\s])name(?:[_\s]|$)",
    r"(?:^|[_\s])description(?:[_\s]|$)",
    r"(?:^|[_\s])desc(?:[_\s]|$)",
    r"(?:^|[_\s])comment(?:s)?(?:[_\s]|$)",
    r"(?:^|[_\s])note(?:s)?(?:[_\s]|$)",
    r"(?:^|[_\s])label(?:[_\s]|$)",
    r"(?:^|[_\s])title(?:[_\s]|$)",
    r"(?:^|[_\s])address(?:[_\s]|$)",
    r"(?:^|[_\s])city(?:[_\s]|$)",
    r"(?:^|[_\s])state(?:[_\s]|$)",
    r"(?:^|[_\s])country(?:[_\s]|$)",
    r"(?:^|[_\s])region(?:[_\s]|$)",
]
DIMENSION_PATTERNS = [
    r"(?:^|[_\s])category(?:[_\s]|$)",
    r"(?:^|[_\s])type(?:[_\s]|$)",
    r"(?:^|[_\s])class(?:[_\s]|$)",
    r"(?:^|[_\s])status(?:[_\s]|$)",
    r"(?:^|[_\s])gender(?:[_\s]|$)",
    r"(?:^|[_\s])segment(?:[_\s]|$)",
    r"(?:^|[_\s])group(?:[_\s]|$)",
    r"(?:^|[_\s])tier(?:[_\s]|$)",
    r"(?:^|[_\s])level(?:[_\s]|$)",
    r"(?:^|[_\s])zone(?:[_\s]|$)",
    r"(?:^|[_\s])color(?:[_\s]|$)",
    r"(?:^|[_\s])make(?:[_\s]|$)",
    r"(?:^|[_\s])model(?:[_\s]|$)",
    r"(?:^|[_\s])brand(?:[_\s]|$)",
    r"(?:^|[_\s])marital(?:[_\s]|$)",
    r"(?:^|[_\s])education(?:[_\s]|$)",
    r"(?:^|[_\s])occupation(?:[_\s]|$)",
    r"(?:^|[_\s])coverage(?:[_\s]|$)",
    r"(?:^|[_\s])use(?:[_\s]|$)",
    r"(?:^|[_\s])parent(?:[_\s]|$)",
    r"(?:^|[_\s])true$",
    r"(?:^|[_\s])false$",
]
# Datatype names per class.
DATE_TYPES = ["date", "datetime", "timestamp", "time"]
BOOLEAN_TYPES = ["boolean", "bool", "bit"]
NUMERIC_TYPES = [
    "integer",
    "int",
    "real",
    "float",
    "double",
    "number",
    "decimal",
    "numeric",
    "bigint",
    "smallint",
    "tinyint",
]
GEO_ROLES = ["ZipCode", "State", "City", "Country", "County", "Geo"]
COUNT_AGGREGATIONS = ["COUNT", "COUNTD", "CNT", "CNTD"]


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def semantic_class(
    field: Column, datatype: Column, role: Column, aggregation: Column, semantic_role: Column
) -> Column:
    """IDENTIFIER, RATIO, AVERAGE, PRE_AGGREGATED, DATE, BOOLEAN, COUNT, ADDITIVE or
    DIMENSION; the first rule that fits decides."""
    name = F.trim(F.coalesce(field, F.lit("")))
    kind = F.lower(F.trim(F.coalesce(datatype, F.lit(""))))
    side = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    agg = F.upper(F.trim(F.coalesce(aggregation, F.lit(""))))
    counted = (side == "measure") & agg.isin(COUNT_AGGREGATIONS)
    category = name.rlike(_any(TEXT_PATTERNS + DIMENSION_PATTERNS))
    return (
        F.when(name == "", "DIMENSION")
        .when(F.coalesce(semantic_role, F.lit("")).rlike("|".join(GEO_ROLES)), "DIMENSION")
        .when(kind.isin(DATE_TYPES), "DATE")
        .when(kind.isin(BOOLEAN_TYPES), "BOOLEAN")
        .when(name.rlike(_any(IDENTIFIER_PATTERNS)), F.when(counted, "COUNT").otherwise("IDENTIFIER"))
        .when(name.rlike(_any(RATIO_PATTERNS)), "RATIO")
        .when(name.rlike(_any(AVERAGE_PATTERNS)), "AVERAGE")
        .when(name.rlike(_any(PRE_AGGREGATED_PATTERNS)), "PRE_AGGREGATED")
        .when(name.rlike(_any(DATE_PATTERNS)), "DATE")
        .when(category, "DIMENSION")
        .when(side == "dimension", "DIMENSION")
        .when(counted, "COUNT")
        .when((side == "measure") & agg.isin("AVG", "MEDIAN", "MED"), "AVERAGE")
        .when(side == "measure", "ADDITIVE")
        .when(kind.isin(NUMERIC_TYPES), "ADDITIVE")
        .otherwise("DIMENSION")
    )


def default_aggregation(semantic: Column, aggregation: Column) -> Column:
    """The aggregate a class of field gets; an additive one keeps its declared aggregate."""
    agg = F.upper(F.trim(F.coalesce(aggregation, F.lit(""))))
    declared = (
        F.when(agg.isin("AVG", "COUNT", "MIN", "MAX", "MEDIAN"), agg)
        .when(agg == "CNT", "COUNT")
        .when(agg.isin("COUNTD", "CNTD"), "COUNT_DISTINCT")
        .when(agg == "MED", "MEDIAN")
        .otherwise("SUM")
    )
    return (
        F.when(semantic == "ADDITIVE", declared)
        .when(semantic.isin("RATIO", "AVERAGE"), "AVG")
        .when(semantic == "COUNT", "COUNT")
        .when(semantic == "PRE_AGGREGATED", "SUM")
        .otherwise("NONE")
    )


def auto_aggregation(columns: DataFrame) -> DataFrame:
    """Add ``semantic`` and ``aggregation`` to a table of fields.

    Columns read: field, datatype, role, default_aggregation, semantic_role; only the
    first is required.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in columns.columns else F.lit(None).cast("string")

    declared = given("default_aggregation")
    classed = columns.withColumn(
        "semantic",
        semantic_class(
            F.col("field"), given("datatype"), given("role"), declared, given("semantic_role")
        ),
    )
    return classed.withColumn("aggregation", default_aggregation(F.col("semantic"), declared))
