"""Headline queries, median of warm runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from wattframe.checks.queries import all_queries
from wattframe.session import local_session

HEADLINE = [
    "a01_downsample", "a01_downsample_lines", "f01_align", "f02_interpolate", "p06_categories", "p11_residual",
    "a03_scale", "w01_profile", "w01_profile_orders", "w02_future", "a07_errors", "d05_scaled_profile",
    "w06_windows", "m01_differencing_order", "m03_difference", "m04_fit", "m07_forecast", "m09_network_scores",
    "m12_regression", "prepared_dataset",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in wanted.split(",") if wanted else HEADLINE:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total of the median warm times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
