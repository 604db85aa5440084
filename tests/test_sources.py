import datetime as dt
import re

from pyspark.sql import functions as F

from wattframe.session import cut_lineage, shared_folder
from wattframe.sources import readings as source
from wattframe.sources import results


def test_platform_csv(spark, tmp_path):
    path = tmp_path / "platform.csv"
    path.write_text(
        "Area,MTU,Biomass  - Actual Aggregated [MW],Hydro Pumped Storage  - Actual Consumption [MW]\n"
        "DE,01.01.2024 00:00 - 01.01.2024 00:15,4500,n/e\n"
        "DE,01.01.2024 00:15 - 01.01.2024 00:30,,12\n"
    )
    got = {(r.ts, r.series): r.value for r in source.read_platform_csv(spark, str(path)).collect()}
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 15)
    bio, hydro = "Biomass Actual Aggregated", "Hydro Pumped Storage Actual Consumption"
    assert got == {(t0, bio): 4500, (t0, hydro): None, (t1, bio): None, (t1, hydro): 12}


def test_platform_names():
    assert source.platform_name("Fossil Coal-derived gas - Actual Aggregated [MW]") == \
        "Fossil Coal-derived gas Actual Aggregated"
    assert source.platform_name("Hydro Run-of-river and poundage  - Actual Aggregated [MW]") == \
        "Hydro Run-of-river and poundage Actual Aggregated"


def test_range_is_half_open_in_berlin(spark, tmp_path):
    hours = spark.sql(
        "select area, explode(sequence(timestamp'2018-05-30 00:00:00Z', timestamp'2018-06-03 00:00:00Z', interval 1 hour))"
        " ts, 'Actual Load' series, double(1) value from values ('10Y1001A1001A83F'), ('other') t(area)")
    path = str(tmp_path / "landed")
    source.write_readings(hours, path)
    got = source.read_readings(spark, path, "20180601", "20180602")
    ends = got.agg(F.min("ts"), F.max("ts"), F.count("*")).select(
        F.unix_seconds(F.col("min(ts)")), F.unix_seconds(F.col("max(ts)")), F.col("count(1)")).first()
    assert tuple(ends) == (1527804000, 1527804000 + 23 * 3600, 24)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*area", plan) and re.search(r"PartitionFilters: \[[^\]]*date", plan)


def test_results_layout(spark, tmp_path):
    path = str(tmp_path / "results")
    run_id = results.write_results(spark.range(3), path, "load", "exp7")
    assert re.fullmatch(r"\d{4}-\d\d-\d\d--\d\d-\d\d-\d\d-load-[0-9a-f]{8}", run_id)
    back = spark.read.parquet(path)
    assert {(r.run_id, r.experiment_id) for r in back.collect()} == {(run_id, "exp7")} and back.count() == 3


def test_models_by_run(spark, tmp_path):
    path = str(tmp_path / "models")
    assert results.load_models(spark, path) is None
    first = results.save_models(spark.range(1), path, "a")
    second = results.save_models(spark.range(1, 2), path, "b")
    assert results.load_models(spark, path, first).first().id == 0
    assert results.load_models(spark, path, second).first().id == 1
    assert results.load_models(spark, path).count() == 1


def test_lineage_is_cut_in_the_named_folder(spark, tmp_path):
    assert shared_folder(spark)
    cut = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert cut.agg(F.sum("x")).first()[0] == 20
    assert "FileScan" in cut._jdf.queryExecution().executedPlan().toString()


def test_platform_files_go_by_name(spark, tmp_path):
    for name, lines in {
        "a.csv": ["Area,MTU,Biomass  - Actual Aggregated [MW],Solar  - Actual Aggregated [MW]", "DE,01.01.2023 00:00 - 01.01.2023 00:15,1,2"],
        "b.csv": ["Area,MTU,Solar  - Actual Aggregated [MW],Biomass  - Actual Aggregated [MW],Waste  - Actual Aggregated [MW]",
                  "DE,01.01.2024 00:00 - 01.01.2024 00:15,2,1,3"],
        "c.csv": ["Area,MTU,Biomass  - Actual Aggregated [MW],Solar  - Actual Aggregated [MW]", "DE,01.01.2025 00:00 - 01.01.2025 00:15,1,n/e"],
    }.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = {(r.ts.year, r.series.split()[0]): r.value for r in source.read_platform_csv(spark, str(tmp_path)).collect()}
    assert got == {(2023, "Biomass"): 1, (2023, "Solar"): 2, (2023, "Waste"): None, (2024, "Biomass"): 1, (2024, "Solar"): 2,
                   (2024, "Waste"): 3, (2025, "Biomass"): 1, (2025, "Solar"): None, (2025, "Waste"): None}


def test_latest_of_two_runs_in_a_second(spark, tmp_path):
    path = str(tmp_path / "models")
    for i in range(4):
        results.save_models(spark.range(i, i + 1), path, "zyxw"[i])
    assert results.load_models(spark, path).first().id == 3


def test_owned_cuts_are_removed(spark):
    import os
    import urllib.parse

    from wattframe.session import owned_cuts

    folder = urllib.parse.urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    with owned_cuts(spark):
        assert cut_lineage(spark.range(3)).count() == 3
        kept = cut_lineage(spark.range(4), owned=False)
        assert len(set(os.listdir(folder)) - before) == 2
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 4


def test_residual_workflow_leaves_nothing(spark, readings):
    import os
    import urllib.parse

    from wattframe.plans.residual import Preparation, prepared, residual_dataset
    from wattframe.session import owned_cuts

    folder = urllib.parse.urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    with owned_cuts(spark):
        rows = prepared(readings([float(i % 24) for i in range(24 * 30)]), Preparation({}, {}, False, None, None))
        assert residual_dataset(rows).where("residual = 0").count() > 0
    assert set(os.listdir(folder)) == before
