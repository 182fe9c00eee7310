from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from viewgrain import sources
from viewgrain.operators.reshape import crosstab, group_members, union_all, unpivot_measures
from viewgrain.plans.settle import drop_settled, settle


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    (tmp_path / "a.tsv").write_text("id\tname\n3\ty\n")
    assert rows(sources.read_files(spark, str(tmp_path / "a.csv"), "csv")) == sorted([(1, "x"), (2, None)], key=repr)
    assert rows(sources.read_files(spark, str(tmp_path / "a.tsv"), "tsv", schema="id int, name string")) == [(3, "y")]
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    df.write.json(str(tmp_path / "j"))
    assert rows(sources.read_files(spark, str(tmp_path / "j"), "json").select("id", "name")) == [(1, "x")]
    with pytest.raises(ValueError):
        sources.read_files(spark, "x", "xml")
    sources.create_table_as(df, "made_once")
    sources.create_table_as(df.union(df), "made_once")
    assert sources.read_table(spark, "made_once").count() == 1
    found = sources.catalog_columns(spark).where("table_name = 'made_once'")
    assert [r.column_name for r in found.orderBy("position").collect()] == ["id", "name"]
    assert sources.search_tables(sources.catalog_columns(spark), "MADE").count() == 1
    spark.sql("DROP TABLE made_once")


def test_the_catalog_lists_all_schemas_and_temporary_views_once(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS other_schema")
    spark.sql("CREATE TABLE other_schema.t (a BIGINT, `b c` DECIMAL(10,2) NOT NULL, d ARRAY<INT>) USING parquet")
    spark.range(1).createOrReplaceTempView("passing")
    got = sources.catalog_columns(spark).where("table_name IN ('t', 'passing')").drop("catalog_name")
    spark.sql("DROP SCHEMA other_schema CASCADE")
    spark.catalog.dropTempView("passing")
    table = [("a", "bigint"), ("b c", "decimal(10,2)"), ("d", "array")]
    want = [("other_schema", "t", name, kind, i) for i, (name, kind) in enumerate(table, 1)] + [(None, "passing", "id", "bigint", 1)]
    assert rows(got.drop("nullable")) == sorted(want, key=repr)
    assert sources.catalog_columns(spark, []).isEmpty()


def test_safe_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Claim CaseNumber", "claim_casenumber", "%", "_x__y_"])
    assert sources.safe_names(df).columns == ["Claim_CaseNumber", "claim_casenumber_2", "%", "x_y"]


def test_custom_query_binds_values_not_text(spark):
    df = spark.createDataFrame([("a",), ("a' OR '1'='1",)], "s string")
    out = sources.custom_query(spark, "SELECT * FROM {t} WHERE s = :v", {"v": "a' OR '1'='1"}, t=df)
    assert out.count() == 1


def test_settle_keeps_names_types_and_nulls(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "`a b` int, `x,y` string, z array<int>")
    kept = settle(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert rows(kept) == rows(df)
    assert drop_settled(spark) >= 1


def test_union_aligns_types(spark):
    a = spark.createDataFrame([(1, "x")], "v int, k string")
    b = spark.createDataFrame([("y", 2.5)], "k string, v double")
    c = spark.createDataFrame([("z", "w")], "k string, v string")
    assert union_all([a, b]).schema["v"].dataType.simpleString() == "double"
    assert union_all([a, c]).schema["v"].dataType.simpleString() == "string"


def test_unpivot_keeps_null_cells(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    out = unpivot_measures(df, ["k"], {"Total_V": F.sum("v"), "N": F.count("v")})
    assert rows(out) == sorted([("a", "Total V", None), ("a", "N", 0.0), ("b", "Total V", 2.0), ("b", "N", 1.0)], key=repr)


def test_groups_and_crosstab(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "x", 4)], "k string, c string, v int")
    named = group_members(df, "k", {"G": ["a"]}, "g")
    assert rows(named.select("g")) == sorted([("G",), ("b",), (None,)], key=repr)
    assert rows(crosstab(named, ["g"], "c", F.sum("v"), ["x", "y"])) == sorted([("G", 1, None), ("b", None, 2), (None, 4, None)], key=repr)
