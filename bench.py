"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: local threads (default 8).
Each query runs once to warm up and once for its time; results go to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from orrery.queries import load  # noqa: E402
from orrery.session import session  # noqa: E402

HEADLINE = [
    "group_aggregate", "star_join", "rollup", "grouping_sets", "window_ranks", "window_offsets", "distinct_on", "window_groups_frame", "correlated_subquery", "range_overlap_join",
    "count_distinct_pairs", "statistics_aggregates", "integrity_lineitem", "integrity_nodes", "integrity_incremental", "block_conflicts", "block_abort_rates", "replica_apply", "text_search", "stream_integrity",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found, _ = load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    scale = folder.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else None}))


if __name__ == "__main__":
    main()
