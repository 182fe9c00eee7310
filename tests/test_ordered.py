"""Ordered calculations: one window and block-wise, against plain Python."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from viewgrain.operators import aggregates, overlays, shapes
from viewgrain.operators import tablecalc as tc
from viewgrain.operators.joins import member_rank


@pytest.fixture(scope="module")
def view(spark):
    """One hot group, small groups, a NULL group, ties and NULL values."""
    rng = random.Random(7)
    data = [("hot", i, rng.choice([1.0, 2.0, 2.0, 5.0, None])) for i in range(40)]
    data += [("b", i, float(i % 3)) for i in range(5)] + [(None, i, 4.0) for i in range(3)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, i int, v double").cache()


CALCS = {
    "running_sum": lambda v: tc.running_value(v, "sum", "v", "o", ["g"], ["i"]),
    "running_avg": lambda v: tc.running_value(v, "avg", "v", "o", ["g"], ["i"]),
    "running_min": lambda v: tc.running_value(v, "min", "v", "o", ["g"], ["-i"]),
    "running_max": lambda v: tc.running_value(v, "max", "v", "o", [], ["g", "i"]),
    "running_count": lambda v: tc.running_value(v, "count", "v", "o", [], ["v", "g", "i"]),
    "moving_sum": lambda v: tc.window_value(v, "sum", "v", "o", ["g"], ["i"], -2, 1),
    "moving_back": lambda v: tc.window_value(v, "max", "v", "o", ["g"], ["i"], -4, -2),
    "moving_ahead": lambda v: tc.window_value(v, "count", "v", "o", ["g"], ["i"], 3, 9),
    "moving_wide": lambda v: tc.window_value(v, "avg", "v", "o", ["g"], ["i"], -15, 20),
    "open_front": lambda v: tc.window_value(v, "sum", "v", "o", ["g"], ["i"], None, 2),
    "open_front_back": lambda v: tc.window_value(v, "count", "v", "o", ["g"], ["i"], None, -3),
    "open_end": lambda v: tc.window_value(v, "min", "v", "o", ["g"], ["i"], -1, None),
    "open_both": lambda v: tc.window_value(v, "avg", "v", "o", ["g"], ["i"]),
    "index": lambda v: tc.index(v, "o", ["g"], ["-v", "i"]),
    "size": lambda v: tc.size(v, "o", ["g"]),
    "first_last": lambda v: tc.first_last(v, "o", "p", ["g"], ["i"]),
    "rank": lambda v: tc.rank(v, "v", "o"),
    "rank_dense": lambda v: tc.rank(v, "v", "o", "dense", ["g"]),
    "rank_unique": lambda v: tc.rank(v, "v", "o", "unique", ["g"], tie_break=["i"]),
    "rank_modified": lambda v: tc.rank(v, "v", "o", "modified", ["g"], ascending=True),
    "rank_percentile": lambda v: tc.rank(v, "v", "o", "percentile", ["g"]),
    "lookup_back": lambda v: tc.lookup(v, "v", "o", -8, ["g"], ["i"]),
    "lookup_ahead": lambda v: tc.lookup(v, "v", "o", 3, [], ["g", "i"]),
    "percent_of_total": lambda v: tc.percent_of_total(v, "v", "o", ["g"]),
    "previous_value": lambda v: tc.previous_value(v.na.fill(0.0), "o", ["g"], ["i"], 3.0, "v", F.lit(0.9)),
    "previous_table": lambda v: tc.previous_value(v.na.fill(0.0), "o", [], ["g", "i"], 1.0, "v"),
    "percentiles": lambda v: aggregates.percentiles(v, ["g"], {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("i", 0.25)}),
    "percentiles_table": lambda v: aggregates.percentiles(v, [], {"a": ("v", 0.3)}),
    "collect_all": lambda v: aggregates.collect_values(v, ["g"], "v", distinct=False, chunk=6),
    "collect_distinct": lambda v: aggregates.collect_values(v, ["g"], "i", chunk=6),
    "boxplot": lambda v: shapes.boxplot(v, ["g"], "v"),
    "reference_median": lambda v: overlays.reference_line(v, ["g", "i"], "v", "median", "pane"),
    "band": lambda v: overlays.distribution_band(v, ["g", "i"], "v", 0.1, 0.8),
    "member_rank": lambda v: member_rank(v, "g", F.sum("v"), "o"),
}


@pytest.mark.parametrize("name", CALCS)
def test_blocks_equal_one_window(view, large, name):
    small = rows(CALCS[name](view))
    with large():
        assert rows(CALCS[name](view)) == small


def by_group(view):
    groups = {}
    for g, i, v in sorted((tuple(r) for r in view.collect()), key=lambda r: r[1]):
        groups.setdefault(g, []).append((i, v))
    return groups


def test_running_sum_by_hand(view):
    want = []
    for g, items in by_group(view).items():
        total = None
        for i, v in items:
            total = total if v is None else (total or 0.0) + v
            want.append((g, i, v, total))
    got = CALCS["running_sum"](view).select("g", "i", "v", "o")
    assert rows(got) == sorted(((a, b, c, d) for a, b, c, d in want), key=repr)


def test_moving_by_hand(view):
    want = []
    for g, items in by_group(view).items():
        for k, (i, v) in enumerate(items):
            near = [x for _, x in items[max(k - 4, 0) : max(k - 1, 0)] if x is not None]
            want.append((g, i, v, max(near) if near else None))
    assert rows(CALCS["moving_back"](view).select("g", "i", "v", "o")) == sorted(want, key=repr)


def test_previous_value_by_hand(view):
    want = []
    for g, items in by_group(view).items():
        x = 3.0
        for i, v in items:
            x = 0.9 * x + (v or 0.0)
            want.append((g, i, v or 0.0, round(x, 6)))
    assert rows(CALCS["previous_value"](view).select("g", "i", "v", "o")) == sorted(want, key=repr)


def test_rank_kinds_by_hand(spark):
    view = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 1)], "k string, v int")
    got = {
        kind: [r.o for r in tc.rank(view, "v", "o", kind, tie_break=["k"]).orderBy("k").collect()]
        for kind in tc.RANK_KINDS
    }
    assert got["rank"] == [1, 2, 2, 4]
    assert got["dense"] == [1, 2, 2, 3]
    assert got["unique"] == [1, 2, 3, 4]
    assert got["modified"] == [1, 3, 3, 4]
    assert got["percentile"] == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_hot_partition_is_cut(view, large):
    from viewgrain.plans.ordered import BLOCK, lay_out

    with large(block_rows=10):
        blocks = lay_out(view, ["g"], ["i"])
        sizes = [r["count"] for r in blocks.rows.groupBy(BLOCK).count().collect()]
    assert blocks.cut and len(sizes) >= 4 and max(sizes) < 40


def test_result_types_do_not_depend_on_size(view, large):
    typed = view.selectExpr("g", "i", "cast(v as decimal(10,2)) d", "i n", "v x", "date_add(date'2020-01-01', i) t")
    calcs = [("sum", "d"), ("sum", "n"), ("sum", "x"), ("min", "t"), ("max", "d"), ("count", "d")]
    for kind, value in calcs:
        for end in (0, 2):
            calc = lambda: tc.window_value(typed, kind, value, "o", ["g"], ["i"], None, end)  # noqa: E731, B023
            small = calc()
            with large():
                cut = calc()
                assert cut.schema["o"].dataType == small.schema["o"].dataType, (kind, value)
                assert rows(cut) == rows(small)


def test_many_rows_in_few_bytes_are_cut(spark, tmp_path):
    from viewgrain.plans.ordered import lay_out
    from viewgrain.plans.settle import is_small

    spark.range(5000).selectExpr("1 AS one", "id % 2 AS two").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.viewgrain.blockRows", "1000")
    try:
        assert is_small(df) and lay_out(df, ["one"], ["two"]).cut
    finally:
        spark.conf.unset("spark.viewgrain.blockRows")


def test_additive_previous_value_needs_no_python(spark, large):
    view = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 1.0)], "i int, v double")
    out = tc.previous_value(view, "o", [], ["i"], 10.0, "v")
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.o for r in out.orderBy("i").collect()] == [11.0, 13.0, None, None]
    with large(block_rows=2):
        assert [r.o for r in tc.previous_value(view, "o", [], ["i"], 10.0, "v").orderBy("i").collect()] == [11.0, 13.0, None, None]


FRAMES = [("sum", -30, 25), ("min", -14, 14), ("max", 0, 20), ("count", -25, -1), ("sum", 8, 30), ("avg", -50, 60),
          ("max", -40, -35), ("count", 33, 36), ("min", 20, 20), ("sum", None, 3), ("min", -9, None), ("max", None, None)]


def test_one_layout_gives_frames_of_any_width(view, large):
    """Frames inside a tile, over ten blocks, far away and open, all from one addressing."""

    def all_values():
        calcs = tc.Calculations(view, ["g"], ["i"])
        for n, (kind, start, end) in enumerate(FRAMES):
            calcs.window(kind, "v", f"w{n}", start, end)
        return calcs.running("sum", "v", "r").index("k").first("a").last("z").size("n").share("v", "s").lookup("v", "l", -12).view()

    small = rows(all_values())
    with large(block_rows=3):
        assert rows(all_values()) == small
    groups = by_group(view)
    for r in all_values().collect():
        values = [v for _, v in groups[r.g]]
        at = [i for i, _ in groups[r.g]].index(r.i)
        for n, (kind, start, end) in enumerate(FRAMES):
            first = 0 if start is None else max(at + start, 0)
            last = len(values) if end is None else max(at + end + 1, 0)
            near = [v for v in values[first:last] if v is not None]
            want = {"sum": sum, "min": min, "max": max, "count": len, "avg": lambda x: sum(x) / len(x)}[kind]
            assert r[f"w{n}"] == pytest.approx(want(near) if near or kind == "count" else None), (r, kind, start, end)


def test_many_calculations_write_the_view_once(view, large, monkeypatch):
    from viewgrain.plans import ordered

    written = []
    real = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df: written.append(df) or real(df))
    with large():
        calcs = tc.Calculations(view, ["g"], ["i"])
        for n, (kind, start, end) in enumerate(FRAMES):
            calcs.window(kind, "v", f"w{n}", start, end)
        assert calcs.lookup("v", "l", 3).view().count() == view.count()
    assert len(written) == 2  # as it came, and cut into blocks
    monkeypatch.setattr(ordered, "MOST_BLOCKS", 3)
    with large(block_rows=2):
        blocks = ordered.lay_out(view, ["g"], ["i"])
        assert blocks.rows.select(ordered.BLOCK).distinct().count() <= 3
        assert rows(tc.running_value(view, "sum", "v", "o", ["g"], ["i"])) == rows(CALCS["running_sum"](view))


def test_a_settled_table_is_not_written_again(view):
    from viewgrain.plans.settle import settle

    kept = settle(view)
    assert settle(kept) is kept and settle(kept.where("i > 1")) is not kept
