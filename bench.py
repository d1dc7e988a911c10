"""Headline queries on one machine: prints one JSON line with the seconds of each.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores.  Each query runs once to compile its plans and is then
timed; all of its rows are computed and discarded.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from graphloom.plans.catalog import QUERIES

HEADLINE = (
    "node_by_id", "search_exact", "search_like", "search_fts_prefix", "search_fts_all_terms", "search_signature", "search_semantic_knn", "search_tiered",
    "callers", "callees", "import_graph", "dead_code", "stats_by_kind", "impact_radius_d2", "shortest_path", "cycles_trade", "context_expand",
    "resolve_import_aware", "sync_diff_status", "session_debounce",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
