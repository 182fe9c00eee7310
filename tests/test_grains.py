"""Many grains, distinct totals, sketches and filter controls against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from contextlib import nullcontext
from statistics import mean

import pytest
from conftest import rows
from pyspark.sql import functions as F

from viewgrain.catalogue import all_queries
from viewgrain.operators import aggregates, filters, reshape, sketches
from viewgrain.operators.lod import Level, levels

SCHEMA = "a string, b string, c int, v double"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    pick = lambda *x: rng.choice(x)
    return [(pick("x", "y", None), pick("p", "q", None), pick(1, 2, 3, 4, None), pick(1.0, 2.5, -3.0, None)) for _ in range(200)]


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, SCHEMA).cache()


def test_levels_of_many_grains(spark, df, data, monkeypatch):
    from viewgrain.operators import lod

    reads = []
    real = lod.group
    monkeypatch.setattr(lod, "group", lambda d, *x: reads.append(d) or real(d, *x))
    wanted = {
        "here": Level(("a", "b"), "sum", "v"),
        "by_a": Level(("a",), "avg", "v"),
        "by_b": Level(("b",), "max", "v"),
        "all": Level((), "count", "v"),
        "most": Level(("a", "c"), "sum", "v", outer="max"),
        "mean": Level(("c",), "min", "v", outer="avg"),
    }
    got = levels(df, ["a", "b"], wanted)
    # The rows are read by the first grouping only; every other one reads a table of a grain.
    assert [any("v" == c or c.startswith("__of_") for c in d.columns) for d in reads].count(True) == 1

    def of(pred, kind):
        values = [r[3] for r in data if pred(r) and r[3] is not None]
        return {"sum": sum, "max": max, "min": min, "avg": mean, "count": len}[kind](values)

    def total(values):
        return sum(values) if values else None

    want = []
    for a, b in {r[:2] for r in data}:
        cells = {r[2] for r in data if r[:2] == (a, b)}
        by_c = [total([r[3] for r in data if r[0] == a and r[2] == c and r[3] is not None]) for c in cells]
        want.append(
            (a, b, of(lambda r: r[:2] == (a, b), "sum"), of(lambda r: r[0] == a, "avg"), of(lambda r: r[1] == b, "max"),
             of(lambda r: True, "count"), max(x for x in by_c if x is not None), mean(of(lambda r: r[2] == c, "min") for c in cells))
        )
    assert rows(got) == sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in w) for w in want], key=repr)


def test_levels_refuse_what_does_not_add_up(df):
    with pytest.raises(ValueError, match="add up"):
        levels(df, ["a"], {"n": Level(("a",), "count_distinct", "v")})
    with pytest.raises(ValueError, match="outer"):
        levels(df, ["a"], {"n": Level(("c",), "sum", "v")})


def test_distinct_totals(df, data):
    got = aggregates.rollup_distinct(df, ["a", "b"], {"n": F.count(F.lit(1))}, {"u": "c", "w": "v"})
    want = []
    for level in (2, 1, 0):
        groups = defaultdict(list)
        for r in data:
            groups[r[:level] + (None,) * (2 - level)].append(r)
        for key, members in groups.items():
            u, w = ({m[i] for m in members} - {None} for i in (2, 3))
            want.append((*key, level, len(members), len(u), len(w)))
    assert rows(got) == sorted(want, key=repr)
    assert "Expand" not in aggregates.distinct_counts(df, [["a", "b"], ["a"], []], {"u": "c"})._jdf.queryExecution().toString()
    cells = aggregates.pivot_distinct(df, ["a"], ["b"], {"n": F.count(F.lit(1))}, {"u": "c"})
    assert {(r.level, r.u) for r in cells.collect() if r.level == "grand_total"} == {("grand_total", 4)}
    assert cells.count() == 9 + 3 + 3 + 1


def test_sketches_merge_to_any_grain(spark):
    base = spark.range(60_000).selectExpr("id % 3 AS a", "id % 7 AS b", "id % 20000 AS u", "CAST(id AS double) AS q")
    stored = sketches.sketched(base, ["a", "b"], {"u": "u"}, {"q": "q"}).cache()
    assert stored.count() == 21
    for dims, distinct in ((["a"], 20_000), (["b"], 60_000 / 7), ([], 20_000)):
        for r in sketches.merged(stored, dims, ["u"], ["q"]).select(sketches.distinct_of("u").alias("n"), sketches.quantile_of("q", 0.25).alias("q")).collect():
            assert r.n == pytest.approx(distinct, rel=0.03) and r.q == pytest.approx(15_000, abs=1200)


def test_approximate_aggregates_are_not_kept_per_distinct_value(spark, large, tmp_path):
    """No sketch and no percentile is grouped by the column whose distinct values are counted."""
    lines = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, NULL, CAST(id % 3 AS string)) AS l_returnflag", "id % 400 AS l_partkey", "CAST(id AS double) AS l_extendedprice"
    )
    # Flags whose prices are all missing, and all infinite.
    odd = spark.sql("SELECT 'none' AS l_returnflag, 1L AS l_partkey, CAST(NULL AS double) AS l_extendedprice UNION ALL SELECT 'inf', 2L, double('inf') FROM range(3)")
    lines.union(odd).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = [(None, True, True), ("1", True, True), ("2", True, True), ("inf", True, True), ("none", True, None)]
    for limits in (nullcontext, large):
        with limits():
            got = all_queries()["approximate_within_tolerance"](spark, str(tmp_path))
            assert rows(got) == sorted(want, key=repr)
            plan = got._jdf.queryExecution().sparkPlan().toString()
            assert "ObjectHashAggregate" in plan and not re.search(r"ObjectHashAggregate\(keys=\[[^\]]*l_partkey", plan)


def test_all_controls_at_once_equal_one_at_a_time(df):
    controls = {"a": F.col("a") == "x", "b": F.col("v") > 0, "c": None}
    got = filters.associativity(df, controls)
    for name in controls:
        others = [p for c, p in controls.items() if c != name and p is not None]
        one = filters.filter_associativity(df, name, others).withColumn(name, F.col(name).cast("string"))
        mine = got.where(F.col("control") == name).select(F.col("value").alias(name), "total_rows", "associated_rows")
        assert rows(mine) == rows(one)


def test_which_layout_several_measures_take():
    shape = reshape.measure_shape
    assert shape("bar", ["d"], ["m", "n"], True) == "pivot"
    assert shape("bar", ["d"], ["m", "n"], False) == "wide"
    assert shape("bar", [], ["m", "n"], True) == "wide"
    assert shape("table", ["d"], ["m"], True) == "wide"
    assert shape("map", ["lat", "d"], ["m", "n"], False, geo=["lat"]) == "geo_bar"
    assert shape("map", ["lat"], ["m", "n"], False, geo=["lat"]) == "wide"
