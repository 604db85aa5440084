"""Residual workflow on generated readings: one long series against many series.

``python bench_scale.py [million rows]`` prints one JSON line per shape.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.functions.timegrid import grid_time
from wattframe.plans.residual import Preparation, prepared, residual_dataset
from wattframe.session import local_session

SHAPES = {"one long series": 1, "650 series in 50 areas": 650}


def readings(spark: SparkSession, rows: int, n_series: int) -> DataFrame:
    """``rows`` readings at 15 minutes from 1990 on, about a tenth of them null."""
    number = F.col("id")
    series = number % n_series
    index = F.floor(number / n_series) + 20 * 365 * 96
    noise = F.rand(1)
    return spark.range(0, rows, 1, 64).select(
        F.concat(F.lit("area"), (F.floor(series / 13)).cast("string")).alias("area"),
        grid_time(index, 900).alias("ts"),
        F.concat(F.lit("type"), (series % 13).cast("string")).alias("series"),
        F.when(noise > 0.1, F.sin(number / 37) * 50 + noise * 10 + 100).alias("value"),
    )


def main() -> None:
    rows = int(float(sys.argv[1]) * 1e6) if len(sys.argv) > 1 else 5_000_000
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "scale")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.sparkContext.setLogLevel("ERROR")
    for name, n_series in SHAPES.items():
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        readings(spark, rows, n_series).write.parquet(f"{folder}/readings")
        source = spark.read.parquet(f"{folder}/readings")
        how = Preparation(categories={"load": ["type0"], "wind": ["type1", "type2"]}, fills={},
                          downsample_seconds=3600, local_offset_hours=None)
        start = time.perf_counter()
        result = residual_dataset(prepared(source, how), on_partial="null")
        result.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - start
        print(json.dumps({"shape": name, "rows": rows, "sec": round(seconds, 1),
                          "rows_per_sec": round(rows / seconds)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
