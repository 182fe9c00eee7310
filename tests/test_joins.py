"""Relationships of a model, and lookups that would multiply rows."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from viewgrain.operators.joins import Model
from viewgrain.operators.metricview import Dimension, Lookup, MetricView


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "a": spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, m int, v string"),
        "b": spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "p int, q int, w int"),
        "c": spark.createDataFrame([(10, "x", 3)], "r int, v string, q int"),
    }


def test_relationships_of_one_pair_all_hold(tables):
    for turned in ({"one": "b", "other": "a", "keys": {"q": "m"}}, {"one": "a", "other": "b", "keys": {"m": "q"}}):
        model = Model("a", tables).relate("a", "b", {"k": "p"}).relate(**turned)
        assert rows(model.view(["m", "w"])) == [(1, 10), (2, 20)]


def test_what_a_model_refuses(tables):
    model = Model("a", tables).relate("a", "b", {"k": "p"})
    with pytest.raises(ValueError, match="several tables"):
        model.view(["q"])
    assert rows(model.view(["v"])) == [("x",), ("y",)]
    with pytest.raises(ValueError, match="no relationship leads"):
        model.view(["r"])


CIRCLE = [("f", "x", {"a": "a"}), ("f", "y", {"b": "b"}), ("x", "z", {"m": "zm"}), ("y", "z", {"n": "zn"})]


@pytest.fixture(scope="module")
def circle(spark):
    """f - x - z - y - f, with many rows on either side of every edge and NULL keys."""
    rng = random.Random(2)
    pick = lambda n: rng.choice([None, *range(n)])
    return {
        "f": spark.createDataFrame([(i, pick(5), pick(5)) for i in range(40)], "id int, a int, b int"),
        "x": spark.createDataFrame([(pick(5), pick(4), f"x{i}") for i in range(12)], "a int, m int, xv string"),
        "y": spark.createDataFrame([(pick(5), pick(4), f"y{i}") for i in range(12)], "b int, n int, yv string"),
        "z": spark.createDataFrame([(pick(4), pick(4), f"z{i}") for i in range(12)], "zm int, zn int, zv string"),
    }


def test_a_circle_of_relationships_must_close(circle):
    """Whatever relationship is named last, all four hold; tables are reduced before they meet."""
    f, x, y, z = (circle[t].collect() for t in "fxyz")
    want = sorted((
        (r.id, s.xv, t.yv, u.zv)
        for r in f for s in x for t in y for u in z
        if None not in (r.a, r.b, s.m, t.n) and r.a == s.a and r.b == t.b and s.m == u.zm and t.n == u.zn
    ), key=repr)
    assert want
    for turn in range(4):
        model = Model("f", circle)
        for one, other, keys in CIRCLE[turn:] + CIRCLE[:turn]:
            model.relate(one, other, keys)
        assert rows(model.view(["id", "xv", "yv", "zv"])) == want
    # Through a table that the view does not use, the circle is not asked for.
    assert model.view(["id", "xv"]).count() == sum(r.a is not None and r.a == s.a for r in f for s in x)


def test_a_circle_keeps_unmatched_rows_if_asked(circle):
    model = Model("f", circle, keep_unmatched=True)
    for edge in CIRCLE:
        model.relate(*edge)
    got = model.view(["id", "xv", "yv", "zv"])
    assert {r.id for r in got.collect()} == set(range(40))


def test_metric_view_refuses_a_doubled_key(spark):
    facts = spark.createDataFrame([(1, 5)], "k int, x int")
    dims = spark.createDataFrame([(1, "n"), (1, "m")], "id int, name string")
    view = MetricView(facts, {"name": Dimension(F.col("name"), "d")}, {"s": F.sum("x")}, {"d": Lookup(dims, {"k": "id"})})
    with pytest.raises(ValueError, match="not unique"):
        view.query(["name"], ["s"])
