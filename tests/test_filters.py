from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from viewgrain.operators import filters as f
from viewgrain.operators.lod import exclude, fixed, fixed_in_view
from viewgrain.operators.reshape import recode, recode_from, set_flag
from viewgrain.operators.view import OrderOfOperations, worksheet


@pytest.fixture(scope="module")
def people(spark):
    data = [("F", "Alaska", 1), ("F", "Texas", 2), ("M", "Hawaii", 3), (None, "Alaska", 4), ("X", None, 5), ("M", "Texas", 6)]
    return spark.createDataFrame(data, "gender string, state string, n int")


def kept(df, predicate):
    return sorted(r.n for r in df.where(predicate).collect())


def test_member_lists_and_null(people):
    assert kept(people, f.isin_members("gender", ["F", "%null%"])) == [1, 2, 4]
    assert kept(people, f.isin_members("gender", ["null"])) == [4]
    assert kept(people, f.isin_members("gender", [])) == []
    assert kept(people, f.notin_members("gender", ["F"])) == [3, 5, 6]
    assert kept(people, f.notin_members("gender", ["F"], keep_null=True)) == [3, 4, 5, 6]
    assert kept(people, f.notin_members("gender", ["F", None])) == [3, 5, 6]


def test_tuple_exclusion_is_not_two_lists(people):
    tuples = {"gender": ["F", "M"], "state": ["Alaska", "Hawaii", "Puerto Rico"]}
    assert kept(people, f.exclude_tuples(tuples)) == [2, 5, 6]
    assert kept(people, f.exclude_tuples(tuples, keep_null=True)) == [2, 4, 5, 6]
    union = f.exclude_tuple_union([tuples, {"gender": ["M"], "state": ["Texas"]}])
    assert kept(people, union) == [2, 5]
    assert kept(people, f.exclude_tuple_union([{"gender": ["F"]}])) == [3, 5, 6]


def test_numeric_member_of_float_dimension(spark):
    codes = spark.createDataFrame([(96707.0,), (1.0,)], "zip double")
    assert codes.where(f.isin_members("zip", [96707])).count() == 1


@pytest.mark.parametrize(
    ("unit", "n", "first", "last"),
    [
        ("day", 1, "2024-01-31", "2024-01-31"),
        ("week", 1, "2024-01-29", "2024-02-04"),
        ("month", 2, "2023-12-01", "2024-01-31"),
        ("quarter", 1, "2024-01-01", "2024-03-31"),
        ("year", 3, "2022-01-01", "2024-12-31"),
        ("month", -2, "2024-01-01", "2024-02-29"),
    ],
)
def test_relative_date(spark, unit, n, first, last):
    days = spark.sql("SELECT explode(sequence(date'2021-01-01', date'2026-01-01')) AS d")
    keep = f.relative_date("d", unit, n, dt.date(2024, 1, 31))
    got = days.where(keep).agg(F.min("d"), F.max("d")).first()
    assert [str(x) for x in got] == [first, last]


def test_date_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(f.in_year("o_orderdate", 1997))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_top_members_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", 1.0), (None, 9.0), ("e", None)], "k string, v double")
    total = F.sum("v")
    names = lambda out: {r.k for r in out.select("k").collect()}
    assert names(f.top_members(df, "k", total, 3)) == {None, "a", "b", "c"}
    assert names(f.top_members(df, "k", total, 3, ties="strict")) == {None, "a", "b"}
    assert names(f.top_members(df, "k", total, 2, ascending=True)) == {"d", "b", "c"}
    assert names(f.top_members(df, "k", total, 9)) == {None, "a", "b", "c", "d", "e"}


def test_sets_of_any_size_with_null(spark):
    df = spark.createDataFrame([(i,) for i in range(500)] + [(None,)], "k int")
    members = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "m int")
    assert f.set_filter(df, "k", members).count() == 201
    assert f.set_filter(df, "k", members, invert=True).count() == 300
    assert set_flag(df, "k", members, "inside").where("inside").count() == 201


def test_entitlement(spark):
    df = spark.createDataFrame([("north", 1), ("south", 2), ("east", 3)], "area string, n int")
    grants = spark.createDataFrame([("ann@x.org", "north"), ("staff", "east"), ("bob@x.org", "south")], "principal string, area string")
    out = f.entitlement_filter(df, "area", grants, "ann@x.org", ["staff"])
    assert sorted(r.n for r in out.collect()) == [1, 3]
    assert df.select(f.user_domain("ann@x.org")).first()[0] == "x.org"


def test_context_filter_before_fixed_and_dimension_after(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 10), ("b", "x", 100), ("b", "z", 1000)], "g string, h string, v int")
    view = OrderOfOperations(
        dims=["g"],
        measures={"s": F.sum("v"), "f": F.max("fixed")},
        context=[F.col("h") != "z"],
        fixed=[lambda rows: fixed(rows, ["g"], {"fixed": F.sum("v")})],
        dimension=[F.col("h") == "x"],
    )
    assert rows(view.apply(df)) == [("a", 1, 11), ("b", 100, 100)]


@pytest.mark.parametrize("is_large", [False, True])
def test_fixed_keeps_null_members(spark, large, is_large):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("b", 4)], "k string, v int")
    if is_large:
        with large():
            out = rows(fixed(df, ["k"], {"t": F.sum("v"), "d": F.count_distinct("v")}))
    else:
        out = rows(fixed(df, ["k"], {"t": F.sum("v"), "d": F.count_distinct("v")}))
    assert out == sorted([("a", 1, 1, 1), (None, 2, 5, 2), (None, 3, 5, 2), ("b", 4, 4, 1)], key=repr)


def test_fixed_in_view_counts_each_member_once(spark):
    df = spark.createDataFrame([("v", "c1", 1), ("v", "c1", 2), ("v", "c2", 10), ("w", "c1", 4)], "v string, c string, x int")
    out = rows(fixed_in_view(df, ["v"], ["c"], F.sum("x"), F.avg, "a"))
    assert out == [("v", 8.5), ("w", 7.0)]


def test_exclude_is_not_the_grand_total(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 7.0)], "y int, m int, v double")
    assert rows(exclude(df, ["y", "m"], ["m"], F.sum("v"), "t")) == [(1, 1, 5.0), (1, 2, 5.0), (2, 1, 7.0)]


def test_worksheet_without_measures_or_dims(people):
    assert worksheet(people, ["gender"]).count() == 6
    assert rows(worksheet(people, [], {"n": F.count("gender")})) == [(5,)]
    with pytest.raises(ValueError, match="channel"):
        worksheet(people, [], channels={"sound": ["gender"]})


def test_recode(spark, people):
    out = recode(people, "gender", {"F": "Female"}).select("gender")
    assert rows(out) == sorted([("Female",), ("Female",), ("M",), (None,), ("X",), ("M",)], key=repr)
    table = spark.createDataFrame([("M", "Male")], "value string, alias string")
    assert recode_from(people, "gender", table).where("gender = 'Male'").count() == 2
