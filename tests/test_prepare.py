import datetime as dt

import numpy as np
import pandas as pd
import pytest

from wattframe.operators import align, compare, prepare, scale
from wattframe.plans import residual


def test_interpolation_edges(readings, values):
    df = readings([None, 1, None, None, 4, None], step=900)
    for block in (900, 1800, 86_400):
        assert values(prepare.interpolate_time(df, block)) == [None, 1, pytest.approx(2), pytest.approx(3), 4, 4]


def test_interpolation_weighs_by_time(readings, values):
    df = readings([("2024-01-01 00:00:00", 0), ("2024-01-01 01:00:00", None), ("2024-01-01 03:00:00", 9)])
    assert values(prepare.interpolate_time(df))[1] == pytest.approx(3)


@pytest.mark.parametrize("block", [3_600, 5 * 3_600, 40 * 86_400])
def test_interpolation_equals_pandas_for_any_block(spark, block):
    rng = np.random.default_rng(1)
    times = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(20_000, 400, False)), unit="min")
    frame = pd.DataFrame({s: np.where(rng.random(400) < 0.7, np.nan, rng.normal(size=400)) for s in "pqr"}, index=times)
    frame["empty"] = np.nan
    long = frame.melt(ignore_index=False, var_name="series").rename_axis("ts").reset_index()
    rows = [("a", r.ts.to_pydatetime(), r.series, None if np.isnan(r.value) else r.value) for r in long.itertuples()]
    df = spark.createDataFrame(rows, "area string, ts timestamp_ntz, series string, value double")
    got = prepare.interpolate_time(df, block).toPandas().pivot(index="ts", columns="series", values="value")
    want = frame.interpolate(method="time")
    np.testing.assert_allclose(got[want.columns].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_mapping_keeps_nulls_and_ignores_absent_members(readings, values):
    geo, other = "Geothermal Actual Aggregated", "Other renewable Actual Aggregated"
    both = prepare.map_categories(readings({geo: [1, None], other: [1, 1], "Marine Actual Aggregated": [5, 6]}))
    assert values(both, series="other_renewable") == [2, None]
    assert values(both, series="Marine Actual Aggregated") == [5, 6]
    assert values(prepare.map_categories(readings({geo: [3, 4]})), series="other_renewable") == [3, 4]


def test_category_order():
    assert prepare.category_order(["solar", "Marine", "gas"]) == ["Marine", "gas", "solar"]
    assert len(prepare.CATEGORIES) == 13 and sum(map(len, prepare.CATEGORIES.values())) == 18


def test_downsample_keeps_empty_bins_and_nulls(readings):
    df = readings([("2024-01-01 00:00:00", 1), ("2024-01-01 00:15:00", 3), ("2024-01-01 00:30:00", None),
                   ("2024-01-01 03:00:00", 7)])
    got = align.downsample(df).orderBy("ts").collect()
    assert [(r.ts.hour, r.value) for r in got] == [(0, 2), (1, None), (2, None), (3, 7)]


def test_downsample_spans_the_area_for_each_series(readings):
    df = readings({"x": [("2024-01-01 00:10:00", 1)], "y": [("2024-01-01 02:10:00", 2)]})
    other = readings({"x": [("2024-01-05 00:10:00", 1)]}, area="b")
    got = align.downsample(df.union(other)).groupBy("area", "series").count().collect()
    assert {(r.area, r.series, r["count"]) for r in got} == {("a", "x", 3), ("a", "y", 3), ("b", "x", 1)}


def test_spine_in_chunks(readings):
    df = readings([("2024-01-01 00:00:00", 1), ("2024-03-01 00:00:00", 2)])
    assert align.downsample(df, 60).count() == 60 * 24 * 60 + 1


def test_align_fills_the_grid(readings):
    load = readings({"Actual Load": [("2024-01-01 00:00:00", 1)]})
    made = readings({"Solar": [("2024-01-01 01:00:00", 2)], "Gas": [("2024-01-01 00:00:00", 3)]})
    got = {(r.ts.hour, r.series): r.value for r in align.combine(load, made).collect()}
    assert got == {(0, "Actual Load"): 1, (1, "Actual Load"): None, (0, "Solar"): None, (1, "Solar"): 2,
                   (0, "Gas"): 3, (1, "Gas"): None}


def test_wide_and_back(readings):
    df = readings({"x": [1, None], "y": [3, 4]})
    wide = align.to_wide(df, ["x", "y"])
    assert wide.columns == ["area", "ts", "x", "y"]
    back = align.to_long(wide, ["area", "ts"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        [(r.area, r.ts, r.series, r.value) for r in df.collect()], key=str)


def test_constant_fill_comes_before_interpolation(spark, readings, values):
    nuclear = "Nuclear Actual Aggregated"
    df = readings({nuclear: [10, None, 30], "Solar Actual Aggregated": [10, None, 30],
                   "Hydro Pumped Storage Actual Consumption": [1, 1, 1]})
    got = residual.prepared(df, residual.Preparation(local_offset_hours=None))
    assert values(got, series="nuclear") == [10, 0, 30]
    assert values(got, series="solar") == [10, 20, 30]
    assert {r.series for r in got.select("series").distinct().collect()} == {"nuclear", "solar"}


def test_local_time_has_no_summer_time(spark):
    rows = spark.sql("select 'a' area, timestamp'2018-05-31 22:00:00Z' ts, 'Nuclear Actual Aggregated' series, "
                     "double(1) value")
    assert residual.prepared(rows).first().ts == dt.datetime(2018, 5, 31, 23)


def test_nan_becomes_null(spark):
    got = prepare.as_float(spark.sql("select double('NaN') value union all select 1.5"))
    assert {r.value for r in got.collect()} == {None, 1.5}


def test_scale_constant_and_round_trip(readings, values):
    same = readings([4, 4, None])
    assert values(scale.scale(same, scale.fit_scaler(same))) == [0, 0, None]
    df = readings({"x": [1, None, -3], "y": [8, 2.5, 0]})
    scaler = scale.fit_scaler(df)
    scaled = scale.scale(df, scaler)
    assert values(scaled, series="x") == [pytest.approx(4 / 11), None, 0]
    assert values(scale.unscale(scaled, scaler)) == [pytest.approx(v) if v is not None else None for v in values(df)]


def test_errors(readings):
    actual, predicted = readings([0, 2, 4]), readings([1, 2, 2])
    got = compare.error_metrics(compare.paired(actual, predicted)).first()
    eps = 2.220446049250313e-16
    assert (got.mae, got.mse, got.n) == (1, pytest.approx(5 / 3), 3)
    assert got.mape == pytest.approx((1 / eps + 0 + 0.5) / 3)


def test_errors_refuse_or_drop_nulls(readings):
    pairs = compare.paired(readings([1, None]), readings([2, 2]))
    with pytest.raises(Exception, match="null in actual or predicted"):
        compare.error_metrics(pairs).collect()
    assert compare.error_metrics(pairs, on_null="drop").first().n == 1


def test_comparison_table(readings):
    diff = compare.aligned_difference(readings({"hard_coal": [3, 4]}), readings({"hard_coal": [1]}))
    got = {(r.ts.hour, r.kind): (r.label, r.value) for r in compare.comparison_table(diff).collect()}
    assert got[(0, "residuals")] == ("Hard coal residuals", 2)
    assert got[(1, "actual")] == ("Hard coal", 4) and got[(1, "predicted")] == ("Hard coal predicted", None)


def test_partitioning_does_not_change_results(spark, readings):
    rng = np.random.default_rng(3)
    df = readings({s: [None if rng.random() < 0.4 else float(v) for v in rng.normal(size=200)] for s in "xyz"})
    seen = set()
    for n in (1, 3, 11):
        got = prepare.interpolate_time(df.repartition(n), 7 * 3_600).orderBy("series", "ts").collect()
        seen.add(tuple((r.series, r.ts, r.value) for r in got))
    assert len(seen) == 1


def test_two_readings_for_a_cell_are_refused(readings):
    df = readings([("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:00:00", 9.0)])
    with pytest.raises(Exception, match="(?i)duplicate"):
        align.align(df).collect()
    with pytest.raises(Exception, match="two readings"):
        align.to_wide(df, ["x"]).collect()
