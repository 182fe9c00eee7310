"""What the physical plans look like."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viewgrain.operators import filters as f
from viewgrain.operators import lod, shapes
from viewgrain.operators import tablecalc as tc
from viewgrain.operators.joins import Model
from viewgrain.operators.view import worksheet
from viewgrain.plans.session import SETTINGS, tune

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{FOLDER}/orders.parquet")


def test_view_reads_only_its_columns(orders):
    plan = plan_of(worksheet(orders, ["o_orderstatus"], {"t": F.sum("o_totalprice")}, [f.in_range("o_totalprice", 10.0)]))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
    assert "GreaterThanOrEqual(o_totalprice,10.0)" in plan


def test_fixed_has_no_window_and_no_cartesian_product(orders):
    for dims in ([], ["o_custkey"]):
        plan = plan_of(lod.fixed(orders, dims, {"t": F.sum("o_totalprice")}))
        assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_percent_of_total_has_no_single_task_window(orders):
    view = worksheet(orders, ["o_custkey"], {"t": F.sum("o_totalprice")})
    assert "Window" not in plan_of(tc.percent_of_total(view, "t", "share", []))


def test_top_members_ranks_without_a_window(orders):
    for ties in ("rank", "strict"):
        plan = plan_of(f.rank_members(orders, "o_custkey", F.count(F.lit(1)), 5, ties=ties))
        assert "Window" not in plan


def test_histogram_needs_no_join(orders):
    plan = plan_of(shapes.histogram(orders, "o_totalprice", bins=10))
    assert "Join" not in plan and "Subquery" in plan


def test_culled_tables_are_not_read(spark, orders):
    customer = spark.read.parquet(f"{FOLDER}/customer.parquet")
    nation = spark.read.parquet(f"{FOLDER}/nation.parquet")
    model = Model("orders", {"orders": orders, "customer": customer, "nation": nation})
    model.relate("orders", "customer", {"o_custkey": "c_custkey"})
    model.relate("customer", "nation", {"c_nationkey": "n_nationkey"})
    assert "nation.parquet" not in plan_of(model.view(["c_mktsegment", "o_totalprice"]))
    assert "customer.parquet" in plan_of(model.view(["n_name", "o_totalprice"]))


def test_a_large_source_is_joined_to_a_settled_result(orders, large):
    with large():
        plan = plan_of(lod.fixed(orders, ["o_orderstatus"], {"t": F.sum("o_totalprice")}))
    # The aggregate is a written table of known size: broadcast, no shuffle of the source.
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_cut_windows_are_bounded_by_block(orders, large):
    with large(block_rows=500):
        plan = plan_of(tc.index(orders, "i", [], ["o_orderkey"]))
    assert "windowspecdefinition(__block" in plan


def test_tune(spark):
    tune(spark)
    assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())


@pytest.fixture
def tiny_skew_limits(spark):
    """Skew limits so low that a hot key of a few thousand rows counts, and no broadcasts."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    tune(spark)
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5000)
    return spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.col("id").alias("v"), F.hash("id").alias("h"))


@pytest.mark.parametrize(
    "job",
    [
        lambda df: lod.fixed(df, ["k"], {"t": F.sum("v")}),
        lambda df: worksheet(f.condition_members(df, "k", F.count(F.lit(1)), lambda n: n > 5), ["k"], {"t": F.sum("v")}),
        lambda df: worksheet(lod.fixed(df, ["k"], {"t": F.sum("v")}), ["k"], {"m": F.max("t")}),
    ],
)
def test_a_hot_null_key_is_split(spark, tiny_skew_limits, job):
    df = skewed(spark)
    out = job(df)
    out.collect()
    assert "skew=true" in plan_of(out)
