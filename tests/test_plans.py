"""Plans and settings: what must hold at scale."""

import os

import numpy as np
import pytest

from wattframe.checks import queries
from wattframe.checks.oracles import all_oracles
from wattframe.operators import align, lags, prepare, profile

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def final_plan(df):
    """The executed plan, subqueries included, without the plans that it began with."""
    df.collect()
    kept, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if skipped is not None and depth > skipped:
            continue
        skipped = depth if "== Initial Plan" in line else None
        if skipped is None:
            kept.append(line)
    return "\n".join(kept)


@needs_tables
@pytest.mark.parametrize("name", [
    "a01_downsample", "w01_profile", "w01_profile_orders", "d01_persistence", "f01_align", "f02_interpolate", "prepared_dataset",
    "a03_scale", "a04_unscale", "d05_scaled_profile",
])
def test_the_table_is_scanned_once(spark, name):
    assert final_plan(queries.all_queries()[name](spark, SF)).count("FileScan") == 1


@needs_tables
@pytest.mark.parametrize("name", ["a02_scaler", "a06_dates", "w03_last_days"])
def test_only_needed_columns_are_read(spark, name):
    plan = queries.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_orderkey" not in plan


@needs_tables
@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_no_cross_join(spark, name):
    plan = queries.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    queries.raw_events(spark, SF).limit(50).write.parquet(path)
    df = prepare.drop_matching(spark.read.parquet(path).where("ts >= timestamp_ntz'2024-01-01 00:10:00'"))
    assert "GreaterThanOrEqual(ts" in df._jdf.queryExecution().executedPlan().toString()


def sparse(readings):
    rng = np.random.default_rng(12)
    data = {s: [None if rng.random() < 0.5 else float(v) for v in rng.normal(size=24 * 30)] for s in "xyz"}
    return readings(data).union(readings({"x": [1.0, None, 3.0] * 240}, area="b")).where("value is not null")


def results(df):
    rows = prepare.interpolate_time(align.align(df), 5 * 86_400)
    grid = prepare.interpolate_time(align.downsample(df), 5 * 86_400)
    out = [
        rows,
        profile.profiles(grid, on_partial="null"),
        lags.persistence(grid, size=100),
        lags.kpss(lags.indexed(grid, 3600).withColumnRenamed("value", "x").where("x is not null"), 5,
                  ["area", "series"], 64),
    ]
    return [sorted((tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in o.collect()), key=str)
            for o in out]


def test_same_results_without_broadcast_and_adaptive_plans(spark, readings):
    df = sparse(readings)
    usual = results(df)
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
               "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert results(df) == usual
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_long_series_is_spread_over_tasks(spark, readings):
    from pyspark.sql import functions as F

    one = spark.range(40_000).select(
        F.lit("a").alias("area"), (F.expr("timestamp_ntz'2020-01-01'") + F.expr("interval '1' hour") * F.col("id"))
        .alias("ts"), F.lit("x").alias("series"), F.when(F.col("id") % 3 > 0, F.rand(1)).alias("value"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for df in (prepare.interpolate_time(one), lags.persistence(one), align.downsample(one)):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) > 1 and max(sizes) < 40_000 * 0.8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_profiles_of_few_dates_read_their_folders_only(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    from pyspark.sql import functions as F

    from wattframe.sources import readings as source

    hours = spark.range(24 * 90).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("area"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr("interval '1' hour") * F.col("id")).alias("ts"),
        F.lit("x").alias("series"), F.col("id").cast("double").alias("value"))
    path = str(tmp_path / "readings")
    source.write_readings(hours, path)
    days, plain = source.read_days(spark, path), hours
    for make in (profile.future_profiles, lambda df: profile.profile_for_date(df, "20240320")):
        got = make(days)
        plan = final_plan(got)
        scans = [line for line in plan.splitlines() if "FileScan" in line and "value" in line]
        assert len(scans) == 1 and "dynamicpruningexpression(date" in scans[0]
        key = lambda df: sorted((r.area, str(r.ts), r.series, r.pslp) for r in df.collect())
        assert key(got) == key(make(plain))
    counts = profile.day_table(days, 3_600)
    assert "ReadSchema: struct<series:string>" in final_plan(counts)
