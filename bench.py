"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a07_weekly_participation",
    "a09_week_action_panel",
    "a10_reserve_week_action_panel",
    "a12_weekly_beneficiary_panel",
    "a14_calendar_week_family_panel",
    "a26_population_overlap",
    "a15_address_universe",
    "s07_decode_logs",
    "s14_dataset_fingerprint",
    "j13_table_diff",
    "w01_global_ordinal",
    "g01_role_graph",
    "g04_components",
    "g05_core_numbers",
    "g06_pagerank",
    "e02_e03_weekly_bounds",
    "a19_route_metrics",
    "i02_i05_hac_difference_in_changes",
    "i11_group_time_att",
]


def main() -> None:
    from tallyweave.catalog import load
    from tallyweave.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{folder}/events.parquet").count()  # JVM and file-system warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
