import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import network, regressor, windows
from wattframe.plans.sequence import train_forecaster


def sig(x):
    return 1 / (1 + np.exp(-x))


def test_cell_by_hand():
    weights = {
        "w_input": np.array([[0.5], [-0.3], [0.8], [0.1]]), "w_hidden": np.array([[0.2], [0.4], [-0.6], [0.7]]),
        "b_gate": np.array([0.1, 0.2, -0.1, 0.0]), "w_out": np.array([[2.0]]), "b_out": np.array([0.5]),
    }
    h = c = 0.0
    for x in (1.0, -2.0):
        i, f = sig(0.5 * x + 0.2 * h + 0.1), sig(-0.3 * x + 0.4 * h + 0.2)
        g, o = np.tanh(0.8 * x - 0.6 * h - 0.1), sig(0.1 * x + 0.7 * h)
        c = f * c + i * g
        h = o * np.tanh(c)
    x = np.array([[[1.0], [-2.0]]])
    assert network.predict(weights, x)[0, 0] == pytest.approx(2 * h + 0.5)
    assert network.predict(weights, x, activation=True)[0, 0] == pytest.approx(np.tanh(2 * h + 0.5))


@pytest.mark.parametrize("activation", [False, True])
def test_gradient_by_finite_differences(activation):
    rng = np.random.default_rng(0)
    weights = network.initial_weights(2, 3, 2, 1)
    x, y = rng.normal(size=(4, 5, 2)), rng.normal(size=(4, 2))
    _, grad = network.loss_and_gradient(weights, x, y, activation)
    flat, got = network.pack(weights), network.pack(grad)
    for k in range(len(flat)):
        sides = []
        for move in (1e-6, -1e-6):
            moved = flat.copy()
            moved[k] += move
            sides.append(network.loss_and_gradient(network.unpack(moved, weights), x, y, activation)[0])
        assert got[k] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-6)


def two_series(n=120):
    t = np.arange(n)
    return {"x": (0.5 + 0.4 * np.sin(t / 4)).astype("float32"), "y": (0.5 + 0.3 * np.cos(t / 4)).astype("float32")}


def test_next_step_for_every_window(readings):
    data = two_series()
    weights = network.initial_weights(2, 4, 2, 2)
    blocks = windows.sequence_blocks(readings(data), 10, 1, 3600, 16)
    got = network.next_step_forecast(blocks, lambda x: network.predict(weights, x), ["x", "y"], 10, 3600, size=16)
    rows = got.orderBy("ts", "series").collect()
    wide = np.column_stack([data["x"], data["y"]]).astype(float)
    cut = np.stack([wide[i : i + 10] for i in range(110)])
    want = network.predict(weights, cut)
    assert len(rows) == 220
    np.testing.assert_allclose([r.predicted for r in rows], want.ravel(), rtol=1e-9)
    np.testing.assert_allclose([r.value for r in rows], wide[10:].ravel(), rtol=1e-6)


def test_n_steps_equal_repeated_single_steps(readings):
    weights = network.initial_weights(2, 4, 2, 3)
    df = readings(two_series(40))
    cut = windows.windows(df, 10, 1, 10, size=16)
    blocks = windows.sequence_blocks(df, 10, 1, 3600, 16)
    got = network.n_step_forecast(blocks, lambda x: network.predict(weights, x), ["x", "y"], 10, 4, 3600, 10, 16)
    sample = np.array(cut.where("window_id = 1").first().sample, dtype=float)[None]
    first = cut.where("window_id = 1").first().target_ts[0]
    for h in range(1, 5):
        out = network.predict(weights, sample)
        rows = got.where(f"window_id = 1 and horizon = {h}").orderBy("series").collect()
        np.testing.assert_allclose([r.predicted for r in rows], out[0], rtol=1e-6)
        assert (rows[0].ts - first).total_seconds() == 3600 * (h - 1)
        sample = np.concatenate([sample[:, 1:], out[:, None]], axis=1)
    assert got.count() == cut.count() * 4 * 2


def test_regression_equals_lstsq(readings):
    rng = np.random.default_rng(5)
    data = {"x": rng.normal(size=200).astype("float32"), "y": rng.normal(size=200).astype("float32")}
    blocks = windows.sequence_blocks(readings(data), 3, 1, 3600, 32)
    beta = regressor.fit_window_regressor(blocks, 2, 3, size=32)
    wide = np.column_stack([data["x"], data["y"]]).astype(float)
    design = np.stack([np.concatenate([[1], wide[i : i + 3].ravel()]) for i in range(197)])
    np.testing.assert_allclose(beta, np.linalg.lstsq(design, wide[3:], rcond=None)[0], rtol=1e-6, atol=1e-9)


def test_training_step_equals_single_machine(readings):
    data = two_series(60)
    weights = network.initial_weights(2, 3, 2, 4)
    blocks = windows.sequence_blocks(readings(data), 5, 1, 3600, 8)
    wide = np.column_stack([data["x"], data["y"]]).astype(float)
    x, y = np.stack([wide[i : i + 5] for i in range(55)]), wide[5:]
    loss, grad = network.loss_and_gradient(weights, x, y)
    losses, dropped, _, state = one_epoch(blocks, weights, 5, 8, 1)
    assert dropped == 0
    assert losses == [pytest.approx(loss / y.size)]
    np.testing.assert_allclose(state.mean / 0.1, network.pack(grad) / y.size, rtol=1e-8)


def one_epoch(blocks, weights, tw, size, n_batches, on_null="error"):
    flat = network.pack(weights)
    state = network._State(flat, np.zeros_like(flat), np.zeros_like(flat))
    dealt = network._dealt(blocks, blocks, n_batches, 3)
    return network._epoch(dealt, state, weights, n_batches, tw, size, False, on_null, 0.01)


def test_training_lowers_the_loss_and_weights_survive(spark, readings):
    weights, history, test_blocks, names = train_forecaster(
        readings(two_series(200)), n_hidden=6, training_window=8, n_epochs=8, learning_rate=0.05, size=64)
    rows = history.orderBy("epoch").collect()
    assert rows[-1].valid_loss < rows[0].valid_loss and rows[-1].train_loss < rows[0].train_loss
    assert names == ["x", "y"] and test_blocks.count() > 0
    table = network.weights_table(spark, weights, "r1")
    back = network.weights_from_table(table, "r1")
    assert all(np.array_equal(back[k], weights[k]) for k in weights)


def test_training_stops_early_and_takes_a_schedule(readings, monkeypatch):
    monkeypatch.setattr(network, "PATIENCE", 1)
    blocks = windows.sequence_blocks(readings(two_series(60)), 5, 1, 3600, 16).persist()
    rates = []

    def schedule(loss):
        rates.append(loss)
        return 50.0

    _, history = network.train(blocks, blocks, network.initial_weights(2, 2, 2), 5, 10, 0.001, n_batches=2,
                               scheduler=schedule, size=16)
    assert history.count() < 10 and len(rates) == history.count() - 1


def test_no_windows_is_an_error(readings):
    blocks = windows.sequence_blocks(readings(two_series(4)), 5, 1, 3600, 16)
    with pytest.raises(ValueError, match="no windows"):
        network.train(blocks, blocks, network.initial_weights(2, 2, 2), 5, 1, size=16)


def test_windows_with_missing_cells_are_not_trained_on(readings):
    data = {k: [float(v) for v in s] for k, s in two_series(60).items()}
    data["x"][30] = None
    blocks = windows.sequence_blocks(readings(data), 5, 1, 3600, 16)
    weights = network.initial_weights(2, 2, 2)
    losses, dropped, valid, state = one_epoch(blocks, weights, 5, 16, 2, "drop")
    assert dropped == 6
    assert np.isfinite([*losses, valid]).all() and np.isfinite(state.flat).all()
    _, history = network.train(blocks, blocks, weights, 5, 1, size=16, on_null="drop")
    assert [r.dropped_windows for r in history.collect()] == [6]
    with pytest.raises(Exception, match="missing cells"):
        network.train(blocks, blocks, weights, 5, 1, size=16)


def test_training_equals_one_machine(readings):
    """Batch after batch in numpy, whatever the number of tasks; more tasks than blocks too."""
    data, tw, size, n_batches, rate = two_series(150), 5, 8, 4, 0.02
    blocks = windows.sequence_blocks(readings(data), tw, 1, 3600, size).persist()
    weights = network.initial_weights(2, 3, 2)
    wide = np.column_stack([data["x"], data["y"]]).astype(np.float32).astype(float)
    batch_of = {r.block: r.batch for r in blocks.select("block", F.pmod(F.hash("area", "block"), F.lit(n_batches)).alias("batch")).collect()}
    base = blocks.agg(F.min("first")).first()[0]
    starts = {b: [s for s in range(150 - tw) if batch_of[(s + base) // size] == b] for b in range(n_batches)}
    cut = lambda own: (np.stack([wide[s : s + tw] for s in own]), np.stack([wide[s + tw] for s in own]))
    flat, state, want = network.pack(weights), None, []
    state = network._State(flat, np.zeros_like(flat), np.zeros_like(flat))
    for epoch in range(3):
        losses = []
        for own in starts.values():
            if own:
                x, y = cut(own)
                loss, gradient = network.loss_and_gradient(network.unpack(state.flat, weights), x, y)
                losses.append(loss / y.size)
                state = state.step(network.pack(gradient) / y.size, rate)
        x, y = cut(range(150 - tw))
        want.append((np.mean(losses), ((network.predict(network.unpack(state.flat, weights), x) - y) ** 2).mean()))
    for workers in (1, 3, 4):
        after, history = network.train(blocks, blocks, weights, tw, 3, rate, n_batches, size=size, workers=workers)
        got = [(r.train_loss, r.valid_loss) for r in history.orderBy("epoch").collect()]
        np.testing.assert_allclose(got, want, rtol=1e-9)
        np.testing.assert_allclose(network.pack(after), state.flat, rtol=1e-7, atol=1e-9)


def test_an_epoch_is_one_job(spark, readings):
    blocks = windows.sequence_blocks(readings(two_series(80)), 5, 1, 3600, 8).persist()
    blocks.count()
    jobs = []
    for n_batches, epochs in ((1, 1), (16, 1), (16, 3)):
        group = f"train-{n_batches}-{epochs}"
        spark.sparkContext.setJobGroup(group, group)
        network.train(blocks, blocks, network.initial_weights(2, 2, 2), 5, epochs, n_batches=n_batches, size=8)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    one, same, three = jobs
    assert one == same and three - same <= 2 * 2  # a job for each further epoch, and its stage of cached blocks


def test_a_failed_task_starts_the_epoch_anew(spark, readings, tmp_path):
    """One task fails in the midst of the first epoch, as a lost executor would; the result is that of a run without it."""
    marker = str(tmp_path / "failed")

    class Breaks:
        """Not the activation, but a failure the first time it is asked."""

        def __bool__(self):
            import os

            from pyspark import BarrierTaskContext

            if BarrierTaskContext.get().partitionId() == 1 and not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("lost")
            return False

    blocks = windows.sequence_blocks(readings(two_series(100)), 5, 1, 3600, 4).persist()
    weights = network.initial_weights(2, 2, 2)
    plain, history = network.train(blocks, blocks, weights, 5, 2, n_batches=3, size=4, workers=3)
    again, other = network.train(blocks, blocks, weights, 5, 2, n_batches=3, size=4, workers=3, activation=Breaks())
    assert os.path.exists(marker)
    assert [r.train_loss for r in other.collect()] == [r.train_loss for r in history.collect()]
    np.testing.assert_array_equal(network.pack(plain), network.pack(again))


def test_unequal_areas_are_refused(readings):
    df = readings(two_series(40)).union(readings({"z": [1.0] * 40}, area="b"))
    weights = network.initial_weights(2, 2, 2)
    blocks = windows.sequence_blocks(df, 4, 1, 3600)
    with pytest.raises(Exception, match="area b has 1 series"):
        network.n_step_forecast(blocks, lambda x: network.predict(weights, x), ["x", "y"], 4, 2, 3600).collect()
    with pytest.raises(Exception, match="area b has 1 series"):
        network.next_step_forecast(blocks, lambda x: network.predict(weights, x), ["x", "y"], 4, 3600).collect()


def test_many_columns_are_solved_step_by_step(readings):
    blocks = windows.sequence_blocks(readings(two_series(120)), 6, 1, 3600, 16)
    direct = regressor.fit_window_regressor(blocks, 2, 6, ridge=0.1, size=16)
    steps = regressor.fit_window_regressor(blocks, 2, 6, ridge=0.1, size=16, direct_columns=0)
    np.testing.assert_allclose(steps, direct, atol=1e-6)


def blocks_of(readings, data, tw, size, areas=("a",)):
    df = None
    for i, area in enumerate(areas):
        own = readings({f"s{j:02d}": [None if np.isnan(v) else v for v in data[i][:, j]] for j in range(data[i].shape[1])}, area=area)
        df = own if df is None else df.union(own)
    return windows.sequence_blocks(df, tw, 1, 3_600, size)


def by_windows(data, tw, ridge):
    """Least squares over every whole window of all areas, formed in full."""
    z, y = [], []
    for x in data:
        x = x.astype(np.float32).astype(float)
        for s in range(len(x) - tw):
            if np.isfinite(x[s : s + tw + 1]).all():
                z.append(np.concatenate([[1], x[s : s + tw].ravel()]))
                y.append(x[s + tw])
    z, y = np.array(z), np.array(y)
    return np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y), z, y


@pytest.mark.parametrize("size", [16, 1000])
def test_lag_products_equal_the_windows(readings, size):
    """Two areas, runs broken by missing cells, blocks shorter than a run: the same equations, and the same solution."""
    rng = np.random.default_rng(8)
    data = [rng.normal(size=(90, 3)).cumsum(0) * 0.1 + 1, rng.normal(size=(70, 3))]
    data[0][40, 1] = data[1][3, 0] = data[1][30, 2] = np.nan
    tw, ridge = 5, 0.3
    blocks = blocks_of(readings, data, tw, size, ("a", "b")).cache()
    want, z, y = by_windows(data, tw, ridge)
    got = regressor.window_equations(blocks, 3, tw, size, "drop")
    full = np.hstack([z[:, 1:], y])
    probe = rng.normal(size=(tw + 1, 3, 2))
    np.testing.assert_allclose(got.apply(probe).reshape(-1, 2), full.T @ full @ probe.reshape(-1, 2), rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(got.sums.ravel(), full.sum(0), rtol=1e-9, atol=1e-9)
    assert got.n == len(z)
    beta = regressor.fit_window_regressor(blocks, 3, tw, ridge, size, "drop", direct_columns=0)
    np.testing.assert_allclose(beta, want, rtol=1e-6, atol=1e-8)
    with pytest.raises(Exception, match="missing cells"):
        regressor.fit_window_regressor(blocks, 3, tw, ridge, size, direct_columns=0)


def test_many_runs_are_solved_by_passes(readings, monkeypatch):
    rng = np.random.default_rng(9)
    data = [rng.normal(size=(120, 2))]
    data[0][::11, 0] = np.nan
    blocks = blocks_of(readings, data, 3, 32).cache()
    monkeypatch.setattr(regressor, "MAX_EDGES", 4)
    assert regressor.window_equations(blocks, 2, 3, 32, "drop") is None
    beta = regressor.fit_window_regressor(blocks, 2, 3, 0.1, 32, "drop", direct_columns=0)
    np.testing.assert_allclose(beta, by_windows(data, 3, 0.1)[0], rtol=1e-6, atol=1e-8)


def test_eight_thousand_columns_in_one_pass(readings):
    """672 steps of 13 series: the gradient of the squares, window by window, vanishes."""
    rng = np.random.default_rng(10)
    tw, width, n, ridge = 672, 13, 1500, 5.0
    x = rng.normal(size=(n, width))
    blocks = blocks_of(readings, [x], tw, 512).cache()
    beta = regressor.fit_window_regressor(blocks, width, tw, ridge, 512)
    assert beta.shape == (1 + tw * width, width) and beta.shape[0] == 8_737
    x = x.astype(np.float32).astype(float)
    z = np.array([np.concatenate([[1], x[s : s + tw].ravel()]) for s in range(n - tw)])
    gradient = z.T @ (x[tw:] - z @ beta) - ridge * beta
    assert np.abs(gradient).max() < 1e-6 * np.abs(z.T @ x[tw:]).max()


def test_lines_of_all_series_at_once(readings):
    rng = np.random.default_rng(11)
    data = {"x": rng.normal(size=80).cumsum(), "y": rng.normal(size=80), "flat": [2.0] * 80}
    df = readings(data)
    lines = regressor.series_lines(df, 3_600, 16)
    got = {r.series: (r.slope, r.intercept) for r in lines.collect()}
    for name in "xy":
        slope, intercept = np.polyfit(data[name][:-1], data[name][1:], 1)
        assert got[name] == (pytest.approx(slope, rel=1e-6), pytest.approx(intercept, rel=1e-6, abs=1e-9))
    assert got["flat"] == (None, None)
    assert regressor.line_forecast(df, lines, 3_600, 16).where("predicted is not null").count() == 2 * 79


def test_lines_after_missing_values(readings):
    """A row after a missing value stays, without a prediction; the first row of a series has none before it."""
    df = readings({"x": [None, None, 1.0, 2.0, 4.0, 3.0, None, 5.0]})
    got = regressor.line_forecast(df, regressor.series_lines(df, 3_600, 3), 3_600, 3).orderBy("ts").collect()
    assert [r.value for r in got] == [None, 1.0, 2.0, 4.0, 3.0, None, 5.0]
    assert [r.predicted is None for r in got] == [True, True, False, False, False, False, True]
