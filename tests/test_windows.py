import datetime as dt

import numpy as np
import pytest

from wattframe.operators import stopping, windows


@pytest.mark.parametrize("tw,pw,stride,count", [(3, 1, 1, 7), (3, 1, 4, 2), (9, 2, 1, 0)])
def test_window_count(readings, tw, pw, stride, count):
    df = readings([float(i) for i in range(10)])
    assert windows.window_count(df, tw, pw, stride).first().n_windows == count
    assert windows.windows(df, tw, pw, stride, size=4).count() == count


@pytest.mark.parametrize("size", [1, 5, 16, 1000])
@pytest.mark.parametrize("stride", [1, 3])
def test_windows_equal_slices_for_any_block(readings, size, stride):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(50, 2)).astype("float32")
    tw, pw = 7, 2
    df = readings({"x": data[:, 0], "y": data[:, 1]}).union(readings({"x": [1.0] * 12, "y": [2.0] * 12}, area="b"))
    got = windows.windows(df, tw, pw, stride, size=size).where("area = 'a'").orderBy("window_id").collect()
    starts = list(range(0, 50 - tw - pw + 1, stride))
    assert [r.window_id for r in got] == list(range(len(starts)))
    for r, i in zip(got, starts):
        np.testing.assert_array_equal(np.array(r.sample, dtype="float32"), data[i : i + tw])
        np.testing.assert_array_equal(np.array(r.target, dtype="float32"), data[i + tw : i + tw + pw])
        assert r.target_ts[0] == dt.datetime(2024, 1, 1) + dt.timedelta(hours=i + tw)
    one = windows.window_at(df, 2, tw, pw, stride)
    assert one.count() == 2 if stride == 1 else one.count() == 1


def test_gap_in_the_grid_is_refused(readings):
    df = readings([("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 1), ("2024-01-01 04:00:00", 1)])
    with pytest.raises(Exception, match="gaps"):
        windows.windows(df, 1, 1).collect()


def test_uneven_series_are_refused(readings):
    df = readings({"x": [1.0] * 6, "y": [1.0] * 5})
    with pytest.raises(Exception, match="align before"):
        windows.windows(df, 2, 1).collect()


def test_split(readings):
    got = windows.chronological_split(readings([1.0] * 10)).orderBy("ts").collect()
    assert [r.part for r in got] == ["train"] * 6 + ["valid"] * 2 + ["test"] * 2


def test_feature_names(readings):
    assert windows.feature_names(readings({"y": [1.0], "x": [1.0]})) == ["x", "y"]


def test_one_window(readings):
    df = readings({"x": [float(i) for i in range(40)], "y": [float(-i) for i in range(40)]})
    every = {r.window_id: r for r in windows.windows(df, 5, 2, 3).collect()}
    for i in (0, 4, max(every)):
        assert windows.window_at(df, i, 5, 2, 3).collect() == [every[i]]
    assert windows.window_at(df, max(every) + 1, 5, 2, 3).count() == 0
    with pytest.raises(Exception, match="gaps"):
        windows.window_at(df.where("hour(ts) <> 3"), 0, 5, 2, 1).collect()


def losses(spark, values, run="r"):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(values)], "run_id string, epoch int, loss double")


def simulate(values, patience, delta):
    best, waited = None, 0
    for i, v in enumerate(values):
        if best is None or v <= best - delta:
            best, waited = v, 0
        else:
            waited += 1
            if waited >= patience:
                return i, best
    return None, best


def test_early_stop(spark):
    got = stopping.early_stop(losses(spark, [5, 4, 4.5, 4, 4.1, 4.2, 4.3, 1]), patience=3).first()
    assert (got.stop_epoch, got.best_loss) == (6, 4)
    never = stopping.early_stop(losses(spark, [5, 4, 3]), patience=3).first()
    assert never.stop_epoch is None and never.best_loss == 3


@pytest.mark.parametrize("delta", [0.0, 0.3])
def test_early_stop_against_a_loop(spark, delta):
    rng = np.random.default_rng(4)
    runs = {f"r{i}": np.round(rng.normal(size=30).cumsum() * 0.2, 3) for i in range(8)}
    df = None
    for name, values in runs.items():
        part = losses(spark, values, name)
        df = part if df is None else df.union(part)
    for r in stopping.early_stop(df, 4, delta).collect():
        assert (r.stop_epoch, r.best_loss) == simulate(runs[r.run_id], 4, delta)


def test_logged_epochs(spark):
    got = stopping.logged_epochs(losses(spark, range(25)), 10).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [0, 10, 20]
