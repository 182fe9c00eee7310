"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and once timed, in full: every output row is computed.
``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from viewgrain.catalogue import all_queries  # noqa: E402
from viewgrain.plans.settle import drop_settled  # noqa: E402

HEADLINE = [
    "ws_region_year",
    "calculated_field",
    "basic_aggregates",
    "top_customers",
    "exclude_tuples",
    "order_of_operations",
    "fixed_customer_total",
    "fixed_distinct",
    "include_avg_per_nation",
    "running_calcs",
    "window_calcs",
    "rank_kinds",
    "pareto_parts",
    "total_from_rows",
    "percentiles",
    "pivot_sets",
    "unpivot_top",
    "metric_view_orders",
    "chart_boxplot",
    "chart_histogram_bins",
    "overlapping_intervals",
    "infer_keys",
    "lineage_edges",
    "impact",
    "snapshot_diff",
    "check_rules",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("viewgrain-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    drop_settled(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}
        )
    )


if __name__ == "__main__":
    main()
