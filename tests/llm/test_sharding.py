from __future__ import annotations

import zlib
from collections import defaultdict

from llm.conftest import odd_rows
from pyspark.sql import functions as F

from viewgrain.llm import sharding
from viewgrain.llm.common import running_totals


def test_shards_are_even_runs_of_documents(odd, none):
    got = sharding.shard(odd).collect()
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(
        ((r[0], *sized(r[1])) for r in odd_rows()), key=repr
    )
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.shard(none).count() == 0


def test_sizes_are_near_equal(session):
    docs = session.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = {r[0]: r[1] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size")).collect()}
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * 195


def test_running_totals_over_many_partitions(session):
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = session.range(500).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), F.pmod(F.col("id") * 37, F.lit(500)).alias("o"))
        got = running_totals(rows, ["g"], ["o"], {"before": F.lit(1), "sum": F.col("o")}).collect()
    finally:
        session.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in (None, "hot"):
        total = 0
        for n, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: r.o)):
            assert (r.before, r["sum"]) == (n, total)
            total += r.o
