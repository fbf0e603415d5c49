"""Headline queries on the driver tables: a warm-up, then the median of up to three runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from popweave.catalog import QUERIES  # noqa: E402
from popweave.session import local_session  # noqa: E402

HEADLINE = [
    "weighted_count_null_kept",
    "slot_sum_tabulate",
    "indicator_mix",
    "share_of_total_topn",
    "weighted_median",
    "group_profile",
    "quantile_classes",
    "natural_classes",
    "apportion_moe",
    "crosswalk_pop_weights",
    "topn_per_group",
    "directory_join_fallback",
    "links_catalogue",
    "strip_tags",
    "snapshot_by_month",
    "box_overlay",
    "ring_overlay",
    "build_crosswalk",
    "map_table",
    "csv_extract",
    "drifting_csv_union",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = 15.0  # seconds of measured runs per query; one run always counts
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
            if sum(taken) > budget:
                break
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
