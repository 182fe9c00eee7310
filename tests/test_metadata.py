from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from conftest import rows
from pyspark.sql import functions as F

from viewgrain.metadata import depths, fields, formulas, graph, inventory, keys, names
from viewgrain.operators.joins import Model, lookup_join, overlap_join


def python_score(a: str, b: str) -> float:
    def clean(n):
        return re.sub(r"[^a-zA-Z0-9_\s]", " ", re.sub(r"[\$!].*$", "", n)).strip().lower()

    x, y = clean(a), clean(b)
    if x == y:
        return 1.0
    p, q = ({t for t in re.split(r"[_\s]+", n) if t} for n in (x, y))
    ratio = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    return 0.6 * ratio + 0.4 * (len(p & q) / len(p | q) if p and q else 0.0)


@pytest.mark.parametrize("min_conf", [0.3, 0.5, 0.85])
def test_match_names_equals_comparing_all_pairs(spark, min_conf):
    rng = random.Random(3)
    parts = ["sales", "orders", "dim", "fact", "customer", "cust", "x", "2024", "zone", "qty"]
    left = [rng.choice(["_", " "]).join(rng.sample(parts, rng.randint(1, 3))) for _ in range(60)]
    left += ["Sheet1$", "Sheet1!A1:Z100", "!!!", "a-b.c", "ab"]
    right = ["_".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(80)]
    right += ["sheet1", "ba", "customers", "$", "SALES", "sales"]
    got = names.match_names(
        spark.createDataFrame([(n,) for n in left], "n string"),
        spark.createDataFrame([(n,) for n in right], "n string"),
        min_conf,
    )
    want = set()
    for a in set(left):
        scores = sorted((-round(python_score(a, b), 4), b) for b in set(right) if python_score(a, b) >= min_conf)
        want |= {(a, b, -score) for score, b in scores[:5]}
    assert {(r.left_name, r.right_name, r.score) for r in got.collect()} == want


def test_infer_keys(spark):
    columns = spark.createDataFrame(
        [
            ("orders", "id", True, 1), ("orders", "customer_id", False, 2), ("orders", "orders_id", False, 3),
            ("customers", "id", True, 1), ("customers", "region_code", False, 2),
            ("regions", "region_code", True, 1), ("region_notes", "regions_id", False, 1),
        ],
        "table_name string, column_name string, is_pk boolean, position int",
    )
    joins = spark.createDataFrame([("orders", "customer_id", "customers", "id")], "from_table string, from_column string, to_table string, to_column string")
    got = {tuple(r) for r in keys.infer_keys(columns, joins=joins).collect()}
    assert got == {
        ("orders", "customer_id", "customers", "id", "join", 0.9),
        ("customers", "region_code", "regions", "region_code", "same_key", 0.7),
        ("region_notes", "regions_id", "regions", "region_code", "table_id", 0.6),
    }


def test_validate_key(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (2,)], "p int")
    assert rows(keys.validate_key(child, parent, {"k": "p"})) == [(4, 1, 1, 1, 0.75)]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_impact_ends_on_cycles_and_takes_diamonds_once(spark):
    edges = edges_of(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b"), ("x", "y")])
    roots = spark.createDataFrame([("a",)], "n string")
    assert rows(graph.impact(edges, roots)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.lineage(edges, spark.createDataFrame([("y",)], "n string"))) == [("x", 1), ("y", 0)]


def test_levels_and_cycles_against_python(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{min(a, b):02d}", f"n{max(a, b):02d}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a != b})
    level: dict[str, int] = {}
    for _ in range(40):
        for a, b in pairs:
            level[a] = level.get(a, 0)
            level[b] = max(level.get(b, 0), level[a] + 1)
    assert dict(rows(graph.topo_levels(edges_of(spark, pairs)))) == level
    assert graph.cycles(edges_of(spark, pairs)).isEmpty()
    looped = pairs + [("n29", "n00"), ("self", "self"), ("n29", "tail")]
    reach = {n: {n} for p in looped for n in p}
    for _ in range(40):
        for a, b in looped:
            reach[a] |= reach[b]
    on_cycle = {n for n in reach if any(n in reach[b] for a, b in looped if a == n)}
    assert {r.node for r in graph.cycles(edges_of(spark, looped)).collect()} == on_cycle


def test_cycle_groups_against_python(spark):
    """Rings, rings in a row, chains inside and between them, pointers at themselves, NULLs."""
    rng = random.Random(3)
    pairs = [(f"r{rng.randrange(30):02d}", f"r{rng.randrange(30):02d}") for _ in range(33)]
    pairs += [(f"s{i:02d}", f"s{(i + 1) % 9:02d}") for i in range(9)] + [("s03", "r01"), ("r02", "t0"), ("t0", "t1"), ("t1", "u0")]
    pairs += [("u0", "u1"), ("u1", "u2"), ("u2", "u0"), ("u1", "v"), ("v", "u0"), ("me", "me"), (None, "r00"), ("r00", None)]
    nodes = {n for p in pairs for n in p if n}
    reach = {n: {b for a, b in pairs if a == n and b} for n in nodes}
    for _ in range(6):
        for n in nodes:
            reach[n] = reach[n].union(*[reach[m] for m in reach[n]])
    want = sorted(((n, min(m for m in reach[n] if n in reach[m])) for n in nodes if n in reach[n]), key=repr)
    assert rows(graph.cycle_groups(edges_of(spark, pairs))) == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Rounds by the logarithm of 10,000, for levels, and for a chain that is a ring."""
    written = []
    real = depths.settle
    monkeypatch.setattr(depths, "settle", lambda df: written.append(1) or real(df))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.topo_levels(chain, spark.range(10_000, 10_003))
    assert got.where("level = node").count() == 10_001 and got.where("level = 0").count() == 3
    assert len(written) < 40
    ring = chain.select("src", (F.col("dst") % 10_000).alias("dst"))
    assert graph.cycle_groups(ring).groupBy("cycle").count().collect() == [(0, 10_000)]
    assert len(written) < 100


def test_levels_send_no_table_through_the_driver(spark, monkeypatch):
    """Tables of a graph that are small as files are joined without a broadcast, round after round."""
    plans = []
    real = depths.settle
    monkeypatch.setattr(depths, "settle", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    key = F.col("id")
    halves = spark.range(1, 200).select(F.floor(key / 2).alias("src"), key.alias("dst"))
    thirds = spark.range(1, 200).select(F.floor(key / 3).alias("src"), key.alias("dst"))
    got = graph.topo_levels(halves.union(thirds), spark.range(500, 503))
    assert {r.node: r.level for r in got.collect()} == {n: n.bit_length() for n in range(200)} | {n: 0 for n in range(500, 503)}
    plans.append(got._jdf.queryExecution().sparkPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_impact_past_the_plain_rounds(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("c05", "c30"), ("c33", "c02"), ("c40", "d"), ("x", "c20")]
    got = dict(rows(graph.impact(edges_of(spark, chain), spark.createDataFrame([("c00",)], "n string"))))
    want = {f"c{i:02d}": i if i < 30 else min(i, 6 + i - 30) for i in range(41)} | {"d": 17}
    assert got == want


def test_a_reference_is_resolved_in_its_own_source(spark):
    def frame(data, schema):
        return spark.createDataFrame(data, schema)

    calcs = [("s1", "t", "a", "[b] + [c] + [a]"), ("s1", "t", "b", "1"), ("s2", "t", "b", "2"), ("s2", "t", "c", "3"), ("s3", "t", "c", "[b]")]
    got = graph.lineage_edges(
        frame([("s1", "t")], "source string, table string"),
        frame([], "source string, table string, column string"),
        frame(calcs, "source string, table string, calc string, formula string"),
        frame([], "worksheet string, field string"),
        frame([], "dashboard string, worksheet string"),
    ).where("edge_type = 'calc_calc'")
    assert rows(got.select("src", "dst")) == [("CF::s1::b", "CF::s1::a"), ("CF::s2::b", "CF::s3::c"), ("CF::s3::c", "CF::s1::a")]


def test_uses_are_distinct_without_being_compared(spark):
    """Ids that two fields share, sources and worksheets without a name, rows that repeat."""
    columns = [("a", "t", "b::c"), ("a::b", "t", "c"), ("a", "t", "x"), ("b", "t", "x"), (None, "t", "n"), (None, "t", "m")]
    calcs = [("a", "t", "d::e", "1"), ("a::d", "t", "e", "1"), ("b", "t", "x", "[e]"), (None, "t", "k", "1"), (None, "t", "l", "1")]
    uses = [(w, f) for w in ("w1", "w2", None) for f in ("b::c", "c", "x", "n", "m", "d::e", "e", "k", "l", "gone", None)] + [("w3", "x"), ("w4", "c")]
    boards = [("d1", "w1"), ("d1", "w1"), ("d2", "w1"), (None, "w2"), (None, "w2"), ("d1", None), ("d1", "gone")]

    def graph_of(columns, calcs):
        return graph.lineage_edges(
            spark.createDataFrame([("a", "t"), ("b", "t")], "source string, table string"),
            spark.createDataFrame(columns * 2, "source string, table string, column string"),
            spark.createDataFrame(calcs * 2, "source string, table string, calc string, formula string"),
            spark.createDataFrame(uses * 2, "worksheet string, field string"),
            spark.createDataFrame(boards, "dashboard string, worksheet string"),
        )

    def made(prefix, *parts):
        return None if None in parts else "::".join((prefix, *parts))

    got = graph_of(columns, calcs)
    kind = lambda name: rows(got.where(F.col("edge_type") == name).select("src", "dst"))
    named = {c[::2] for c in columns} - {c[::2] for c in calcs}
    assert kind("column_worksheet") == sorted({(made("COL", s, c), made("WS", w)) for s, c in named for w, f in uses if f == c}, key=repr)
    assert kind("calc_worksheet") == sorted({(made("CF", c[0], c[2]), made("WS", w)) for c in calcs for w, f in uses if f == c[2]}, key=repr)
    assert kind("worksheet_dashboard") == sorted([("WS::w1", "DB::d1"), ("WS::w1", "DB::d2"), ("WS::w2", None)], key=repr)
    assert got.count() == got.distinct().count()
    # Where no two fields share an id, no aggregate stands over the joins that make the uses.
    plain = graph_of(columns[1:4], calcs[1:4])
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and not re.search(r"Aggregate \[[^\n]*(column|calc)_worksheet", plan)


def test_tables_named_alike_but_for_case(spark):
    columns = [("orders", "Cust_ID", False, 1), ("cust", "id", True, 1), ("Cust", "ID", True, 1), ("CUST", "Id", True, 1)]
    frame = spark.createDataFrame(columns, "table_name string, column_name string, is_pk boolean, position int")
    got = keys.infer_keys(frame).where("from_table = 'orders'").select("to_table", "to_column")
    assert rows(got) == [("CUST", "Id")]


def test_a_stored_diff_reads_only_what_differs(spark, tmp_path):
    old = spark.range(500).selectExpr("IF(id = 9, NULL, id) AS k", "id % 7 AS v", "CAST(id AS string) AS s")
    new = old.where("k IS NULL OR k <> 20").withColumn("v", F.when(F.col("k") == 30, 99).otherwise(F.col("v"))).union(
        spark.createDataFrame([(1000, 1, "x")], "k long, v long, s string")
    )
    for name, df in (("old", old), ("new", new), ("wider", new.withColumn("more", F.lit(1)))):
        inventory.store_snapshot(df, ["k"], str(tmp_path / name), 32)
    got = inventory.stored_diff(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["k"])
    assert rows(got) == sorted([(20, "removed"), (30, "modified"), (1000, "added")], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Three keys, three of the thirty-two buckets at most: the scans are pruned to their folders.
    listed = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert listed and all(re.search(r"IN \(\d+(,\d+){0,2}\)$|= \d+\)$", f) for f in listed)
    assert rows(got) == rows(inventory.snapshot_diff(old, new, ["k"]))
    same = inventory.stored_diff(spark, str(tmp_path / "old"), str(tmp_path / "old"), ["k"])
    assert same.isEmpty()
    assert inventory.stored_diff(spark, str(tmp_path / "old"), str(tmp_path / "wider"), ["k"]).count() == 501


def test_levels_leave_out_what_a_cycle_feeds(spark):
    got = graph.topo_levels(edges_of(spark, [("a", "b"), ("x", "y"), ("y", "x"), ("y", "b")]))
    assert rows(got) == [("a", 0)]


def test_orphans_are_joined_in_parts_of_bounded_rows(spark, large):
    """Nodes that repeat or have no id, edges that name a node many times."""
    nodes = [(f"n{i % 40}", "column" if i % 2 else "table") for i in range(60)] + [(None, "column"), (None, "column"), ("n1", None)]
    edges = [(f"n{i % 25}",) for i in range(200)] + [(None,)]
    schema = "id string, type string"
    of, used = spark.createDataFrame(nodes[:30], schema).union(spark.createDataFrame(nodes[30:], schema)), spark.createDataFrame(edges, "src string")
    want = sorted([n for n in nodes if n[1] == "column" and (n[0] is None or (n[0],) not in edges)], key=repr)
    assert rows(graph.orphans(of, used)) == want
    with large():
        got = graph.orphans(of, used)
        assert rows(got) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    # 32 nodes of the types and 201 edges, seven rows a part: it is not left to the shuffled bytes.
    # One join, not one for each part of the union.
    assert plan.count("Join ") == 1 and plan.count("RepartitionByExpression [id") == 2 and set(re.findall(r"RepartitionByExpression \[id#\d+\], (\d+)", plan)) == {"34"}


def test_formulas(spark):
    df = spark.createDataFrame(
        [("{FIXED [Region] : SUM([Sales])}",), ("RANK(SUM([Sales]))",), ("[Price (net)] / Len([Name])",), ("FINDNTH([a], 'b', 2)",)],
        "formula string",
    )
    kinds = [r.k for r in df.select(formulas.classify_formula("formula").alias("k")).collect()]
    assert kinds == ["LOD", "TABLE_CALC", "STANDARD", "STANDARD"]
    assert {r.function for r in formulas.formula_tokens(df).collect()} == {"SUM", "RANK", "LEN", "FINDNTH"}
    assert {r.ref for r in formulas.formula_refs(df).collect()} == {"Region", "Sales", "Price (net)", "Name", "a"}
    assert {r.function for r in formulas.function_coverage(df).collect()} == {"RANK", "FINDNTH"}


@pytest.mark.parametrize(
    ("field", "datatype", "role", "declared", "semantic", "aggregation"),
    [
        ("Policy Number", "integer", "measure", "SUM", "IDENTIFIER", "NONE"),
        ("Customer ID", "integer", "measure", "COUNTD", "COUNT", "COUNT"),
        ("Claim_Paid_Ratio", "real", "measure", None, "RATIO", "AVG"),
        ("Total Claim", "real", "measure", None, "PRE_AGGREGATED", "SUM"),
        ("avg_price", "real", "measure", None, "AVERAGE", "AVG"),
        # "ratio" matches anywhere in a name, so also in "duration".
        ("avg_duration", "real", "measure", None, "RATIO", "AVG"),
        ("Order Date", "string", "", None, "DATE", "NONE"),
        ("Postal Code", "real", "dimension", None, "IDENTIFIER", "NONE"),
        ("Sales", "real", "measure", "MED", "AVERAGE", "AVG"),
        ("Sales", "real", "measure", "MIN", "ADDITIVE", "MIN"),
        ("Sales", "real", "", None, "ADDITIVE", "SUM"),
        ("Car Make", "string", "", None, "DIMENSION", "NONE"),
        ("is_true", "string", "", None, "DIMENSION", "NONE"),
        ("Above", "boolean", "measure", None, "BOOLEAN", "NONE"),
        ("", "real", "measure", None, "DIMENSION", "NONE"),
    ],
)
def test_default_aggregation(spark, field, datatype, role, declared, semantic, aggregation):
    df = spark.createDataFrame([(field, datatype, role, declared)], "field string, datatype string, role string, default_aggregation string")
    got = fields.auto_aggregation(df).first()
    assert (got.semantic, got.aggregation) == (semantic, aggregation)


def test_snapshot_diff_with_null_keys_and_values(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (None, "n", 1), (4, None, 5)], "k int, s string, v int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (None, "n", 1), (4, "x", 5), (5, "e", 1)], "k int, s string, v int")
    assert rows(inventory.snapshot_diff(old, new, ["k"])) == [(2, "modified"), (4, "modified"), (5, "added")]
    swapped = spark.createDataFrame([(1, None, "a")], "k int, a string, b string")
    other = spark.createDataFrame([(1, "a", None)], "k int, a string, b string")
    assert rows(inventory.snapshot_diff(swapped, other, ["k"])) == [(1, "modified")]


def test_reconcile_ignores_order_and_finds_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (2, "y")], "k int, s string")
    assert all(r.equal for r in inventory.reconcile(a, b).collect())
    c = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, s string")
    assert {r.item: r.equal for r in inventory.reconcile(a, c).collect()}["row"] is False


def test_dedupe_queries(spark):
    datasets = spark.createDataFrame([("d2", "Q1"), ("d1", "Q1"), ("d3", "Q2")], "dataset string, query string")
    widgets = spark.createDataFrame([("w1", "d2"), ("w1", "d1"), ("w2", "d3"), ("w3", "gone")], "widget string, dataset string")
    kept, pointed = inventory.dedupe_queries(datasets, widgets)
    assert sorted(r.dataset for r in kept.collect()) == ["d1", "d3"]
    assert rows(pointed) == [("w1", "d1"), ("w2", "d3"), ("w3", "gone")]


def test_complexity_label_uses_the_uncapped_score(spark):
    df = spark.createDataFrame([(3, 0), (40, 1), (2, 9)], "field_count int, lod_count int")
    assert rows(inventory.complexity(df).select("score", "label")) == [(100, "Very Complex"), (35, "Medium"), (6, "Simple")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_comparing_all_pairs(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(120):
        start = rng.randrange(1000)
        data.append((i, rng.choice(["hot", "hot", "b", None]), start, start + rng.choice([1, 3, 10, 64, 900])))
    df = spark.createDataFrame(data, "id int, g string, lo int, hi int")
    got = {(r.id_1, r.id_2) for r in overlap_join(df, "lo", "hi", ["g"], "id").collect()}
    want = {
        (a[0], b[0])
        for a in data for b in data
        if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and b[2] < a[3] and a[2] < b[3]
    }
    assert got == want
    assert overlap_join(df, "lo", "hi", ["g"], "id").count() == len(want)


def test_model_joins_only_what_a_view_needs(spark):
    a = spark.createDataFrame([(1, 1), (2, 9)], "a int, bk int")
    b = spark.createDataFrame([(1, 5)], "b int, ck int")
    c = spark.createDataFrame([(5, "c")], "c int, cname string")
    model = Model("a", {"a": a, "b": b, "c": c}).relate("b", "c", {"ck": "c"}).relate("a", "b", {"bk": "b"})
    assert rows(model.view(["a"])) == [(1,), (2,)]
    assert rows(model.view(["a", "cname"])) == [(1, "c")]
    model.keep_unmatched = True
    assert rows(model.view(["a", "cname"])) == [(1, "c"), (2, None)]


def test_lookup_refuses_a_key_that_is_not_unique(spark):
    fact = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, n string")
    with pytest.raises(ValueError, match="not unique"):
        lookup_join(fact, dim, {"k": "k"})
    assert rows(lookup_join(fact, dim.where("n = 'a'"), {"k": "k"})) == [(1, "a"), (2, None)]


def test_model_keeps_the_first_of_two_columns_with_one_name(spark):
    left = spark.createDataFrame([(1, "l")], "id int, note string")
    right = spark.createDataFrame([(1, "r", 7)], "id int, note string, extra int")
    model = Model("left", {"left": left, "right": right}).relate("left", "right", {"id": "id"})
    assert rows(model.view(["id", "note", "extra"])) == [(1, "l", 7)]
