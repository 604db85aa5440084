"""Single-step recurrent forecaster: scoring and training on block rows.

Scoring and training read the rows of ``windows.sequence_blocks``. A window is
cut inside the task as a view, so windows are never shuffled or stored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timegrid import grid_time
from .windows import WINDOW_BLOCK

Weights = dict[str, np.ndarray]
BATCH = 256
# Fixed value: epochs without improvement before training stops.
PATIENCE = 10


def initial_weights(n_features: int, n_hidden: int, n_outputs: int, seed: int = 0) -> Weights:
    """Uniform in +-1/sqrt(hidden). Gate order in the stacked rows: input, forget, cell, output."""
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(n_hidden)
    shapes = {
        "w_input": (4 * n_hidden, n_features),
        "w_hidden": (4 * n_hidden, n_hidden),
        "b_gate": (4 * n_hidden,),
        "w_out": (n_outputs, n_hidden),
        "b_out": (n_outputs,),
    }
    return {name: rng.uniform(-bound, bound, shape) for name, shape in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(weights: Weights, x: np.ndarray, keep: bool = False):
    """Hidden state after the last step for ``x[N, T, F]``; with ``keep`` also what backpropagation needs."""
    n, hidden = len(x), weights["w_hidden"].shape[1]
    h, c, trace = np.zeros((n, hidden)), np.zeros((n, hidden)), []
    for t in range(x.shape[1]):
        gates = x[:, t] @ weights["w_input"].T + h @ weights["w_hidden"].T + weights["b_gate"]
        i, f, o = (_sigmoid(gates[:, k * hidden : (k + 1) * hidden]) for k in (0, 1, 3))
        g = np.tanh(gates[:, 2 * hidden : 3 * hidden])
        before_h, before_c = h, c
        c = f * c + i * g
        h = o * np.tanh(c)
        if keep:
            trace.append((before_h, before_c, i, f, g, o, c))
    return h, trace


def predict(weights: Weights, x: np.ndarray, activation: bool = False) -> np.ndarray:
    """Next vector for each window (M-09): last hidden state, linear layer, optional tanh."""
    h, _ = _run(weights, np.asarray(x, dtype=float))
    out = h @ weights["w_out"].T + weights["b_out"]
    return np.tanh(out) if activation else out


def loss_and_gradient(weights: Weights, x: np.ndarray, y: np.ndarray, activation: bool = False):
    """Sum of squared errors over all cells and its gradient, by backpropagation through time."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    hidden = weights["w_hidden"].shape[1]
    h, trace = _run(weights, x, keep=True)
    out = h @ weights["w_out"].T + weights["b_out"]
    predicted = np.tanh(out) if activation else out
    error = predicted - y
    d_out = 2 * error * (1 - predicted**2) if activation else 2 * error
    grad = {name: np.zeros_like(value) for name, value in weights.items()}
    grad["w_out"], grad["b_out"] = d_out.T @ h, d_out.sum(axis=0)
    d_h, d_c = d_out @ weights["w_out"], np.zeros((len(x), hidden))
    for t in range(x.shape[1] - 1, -1, -1):
        before_h, before_c, i, f, g, o, c = trace[t]
        tanh_c = np.tanh(c)
        d_c = d_c + d_h * o * (1 - tanh_c**2)
        d_gates = np.hstack([
            d_c * g * i * (1 - i),
            d_c * before_c * f * (1 - f),
            d_c * i * (1 - g**2),
            d_h * tanh_c * o * (1 - o),
        ])
        grad["w_input"] += d_gates.T @ x[:, t]
        grad["w_hidden"] += d_gates.T @ before_h
        grad["b_gate"] += d_gates.sum(axis=0)
        d_h, d_c = d_gates @ weights["w_hidden"], d_c * f
    return float((error**2).sum()), grad


def pack(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parts[name].ravel() for name in sorted(parts)])


def unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for name in sorted(like):
        size = like[name].size
        out[name] = np.asarray(flat[at : at + size], dtype=float).reshape(like[name].shape)
        at += size
    return out


# ---------------------------------------------------------------- windows inside a task


def flat_blocks(blocks: DataFrame) -> DataFrame:
    """Block rows with their vectors as one flat array, which reaches the task as a numpy array."""
    return blocks.select(
        "area", "block", "first", "last", "width",
        F.col("rows")[0]["idx"].alias("base"),
        F.flatten("rows.values").alias("cells"),
    )


def block_windows(row, training_window: int, stride: int, size: int):
    """Windows that start in this block, in pieces of ``BATCH``: (x, y, target positions)."""
    values = np.asarray(row.cells, dtype=float).reshape(-1, row.width)
    low = max(row.block * size, row.first)
    low += (row.first - low) % stride
    high = min((row.block + 1) * size - 1, row.last - training_window)
    starts = np.arange(low, high + 1, stride) - row.base
    for k in range(0, len(starts), BATCH):
        part = starts[k : k + BATCH]
        x = values[part[:, None] + np.arange(training_window)[None, :]]
        yield x, values[part + training_window], part + training_window + row.base


def complete_windows(row, training_window: int, size: int, on_null: str = "error"):
    """The windows of a block in which no cell is missing, and how many were left out: (x, y, dropped)."""
    for x, y, at in block_windows(row, training_window, 1, size):
        known = np.isfinite(x).all(axis=(1, 2)) & np.isfinite(y).all(axis=1)
        if on_null == "error" and not known.all():
            raise ValueError(f"area {row.area} has windows with missing cells; fill them or pass on_null='drop'")
        yield x[known], y[known], int((~known).sum())


def next_step_forecast(
    blocks: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray],
    series: list[str],
    training_window: int,
    step: int,
    stride: int = 1,
    size: int = WINDOW_BLOCK,
) -> DataFrame:
    """One prediction per window: ``(area, ts, series, value, predicted)`` (M-11).

    ``blocks`` come from ``sequence_blocks(..., prediction_window=1)`` and
    ``scorer`` maps float[N][tw][F] to float[N][F].
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.width != len(series):
                    raise ValueError(f"area {row.area} has {row.width} series, the scorer {len(series)}")
                for x, y, at in block_windows(row, training_window, stride, size):
                    yield pd.DataFrame({
                        "area": row.area,
                        "idx": np.repeat(at, len(series)),
                        "series": np.tile(series, len(at)),
                        "value": y.ravel(),
                        "predicted": scorer(x).ravel(),
                    })

    scored = flat_blocks(blocks).mapInPandas(run, "area string, idx bigint, series string, value double, predicted double")
    return scored.select("area", grid_time(F.col("idx"), step).alias("ts"), "series", "value", "predicted")


def n_step_forecast(
    blocks: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray],
    series: list[str],
    training_window: int,
    n: int,
    step: int,
    stride: int = 1,
    size: int = WINDOW_BLOCK,
) -> DataFrame:
    """``n`` recursive predictions per window: ``(area, window_id, horizon, ts, series, predicted)`` (M-10).

    ``blocks`` come from ``sequence_blocks(..., prediction_window=1)``; windows are cut inside the task. After each
    step the oldest row leaves the sample and the prediction joins it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.width != len(series):
                    raise ValueError(f"area {row.area} has {row.width} series, the scorer {len(series)}")
                for x, _, at in block_windows(row, training_window, stride, size):
                    for h in range(n):
                        out = scorer(x)
                        x = np.concatenate([x[:, 1:], out[:, None, :]], axis=1)
                        yield pd.DataFrame({
                            "area": row.area,
                            "window_id": np.repeat((at - training_window - row.first) // stride, len(series)),
                            "horizon": h + 1,
                            "idx": np.repeat(at + h, len(series)),
                            "series": np.tile(series, len(at)),
                            "predicted": out.ravel(),
                        })

    schema = "area string, window_id bigint, horizon int, idx bigint, series string, predicted double"
    scored = flat_blocks(blocks).mapInPandas(run, schema)
    return scored.select("area", "window_id", "horizon", grid_time(F.col("idx"), step).alias("ts"), "series", "predicted")


# ---------------------------------------------------------------- training


@dataclass
class _State:
    """Weights and running means of the step rule."""

    flat: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    ticks: int = 0

    def step(self, gradient: np.ndarray, learning_rate: float) -> _State:
        """One step of the Adam rule (Kingma and Ba 2015)."""
        mean, square = 0.9 * self.mean + 0.1 * gradient, 0.999 * self.square + 0.001 * gradient**2
        ticks = self.ticks + 1
        move = (mean / (1 - 0.9**ticks)) / (np.sqrt(square / (1 - 0.999**ticks)) + 1e-8)
        return _State(self.flat - learning_rate * move, mean, square, ticks)


def _dealt(train_blocks: DataFrame, valid_blocks: DataFrame, n_batches: int, workers: int) -> DataFrame:
    """Blocks on as many tasks as take part, in the order of their batches; the validation is the last batch."""
    batch = F.pmod(F.hash("area", "block"), F.lit(n_batches))
    rows = flat_blocks(train_blocks).withColumn("batch", batch).unionByName(
        flat_blocks(valid_blocks).withColumn("batch", F.lit(n_batches)))
    return rows.repartition(workers, F.hash("area", "block", "batch")).sortWithinPartitions("batch").persist(StorageLevel.DISK_ONLY)


def _epoch(
    dealt: DataFrame, state: _State, like: Weights, n_batches: int, training_window: int, size: int, activation: bool,
    on_null: str, learning_rate: float,
):
    """All batches of an epoch in one barrier stage: ``(losses, dropped, valid loss, state)``.

    After each batch the tasks gather each other's sums of loss, cells and gradient, add them in the order of the
    tasks and take the same step, so that all have the same weights without the driver. A lost task starts the
    stage anew, from the weights at the epoch's beginning.
    """
    broadcast = dealt.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context, now = BarrierTaskContext.get(), broadcast.value
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        row, losses, dropped, valid = next(rows, None), [], 0, None
        for number in range(n_batches + 1):
            train, current = number < n_batches, unpack(now.flat, like)
            sums = np.zeros(3 + (len(now.flat) if train else 0))
            while row is not None and row.batch == number:
                for x, y, left_out in complete_windows(row, training_window, size, on_null):
                    if train:
                        part, gradient = loss_and_gradient(current, x, y, activation)
                        sums[3:] += pack(gradient)
                    else:
                        part = float(((predict(current, x, activation) - y) ** 2).sum())
                    sums[:3] += part, y.size, left_out
                row = next(rows, None)
            gathered = context.allGather(base64.b64encode(sums.tobytes()).decode())
            total = np.sum([np.frombuffer(base64.b64decode(g)) for g in gathered], axis=0)
            if not total[1]:  # no whole window in this batch
                continue
            if train:
                losses.append(total[0] / total[1])
                dropped += int(total[2])
                now = now.step(total[3:] / total[1], learning_rate)
            else:
                valid = total[0] / total[1]
        if context.partitionId() == 0:
            yield pd.DataFrame({"losses": [losses], "dropped": [dropped], "valid": [valid], "flat": [now.flat], "mean": [now.mean],
                                "square": [now.square], "ticks": [now.ticks]})

    schema = ("losses array<double>, dropped bigint, valid double, flat array<double>, mean array<double>, square array<double>, "
              "ticks int")
    # Spark starts a failed barrier stage anew only if a shuffle comes after it
    found = dealt.mapInPandas(run, schema, barrier=True).repartition(1).collect()[0]
    broadcast.destroy()
    after = _State(*(np.array(found[c], dtype=float) for c in ("flat", "mean", "square")), found.ticks)
    return found.losses, found.dropped, found.valid, after


def train(
    train_blocks: DataFrame,
    valid_blocks: DataFrame,
    weights: Weights,
    training_window: int,
    n_epochs: int,
    learning_rate: float = 0.01,
    n_batches: int = 8,
    activation: bool = False,
    scheduler: Callable[[float], float] | None = None,
    size: int = WINDOW_BLOCK,
    on_null: str = "error",
    workers: int | None = None,
) -> tuple[Weights, DataFrame]:
    """Data-parallel training on the mean squared error (M-13, A-09).

    An epoch is one job, whatever the number of batches: a barrier stage of ``workers`` tasks, which must be able
    to run at the same time (default: the cluster's cores as Spark counts them). The blocks are dealt to the tasks
    once and kept on their disks; each task holds one block and two vectors of model size for each other task.
    Batches are disjoint sets of blocks; the loss of an epoch is the mean of its batch losses. A window with a
    missing cell raises; with ``on_null='drop'`` it is left out and counted in ``dropped_windows``. Training stops
    after ``PATIENCE`` epochs without improvement; the last weights are returned. ``scheduler(valid_loss)`` may set
    the learning rate of the next epoch. Pass checkpointed blocks.
    """
    spark = train_blocks.sparkSession
    flat = pack(weights)
    state = _State(flat, np.zeros_like(flat), np.zeros_like(flat))
    best, waited, history = None, 0, []
    dealt = _dealt(train_blocks, valid_blocks, n_batches, workers or spark.sparkContext.defaultParallelism)
    try:
        for epoch in range(n_epochs):
            losses, dropped, valid, state = _epoch(
                dealt, state, weights, n_batches, training_window, size, activation, on_null, learning_rate)
            if valid is None or not losses:
                raise ValueError("no windows: the series are shorter than one window")
            history.append((epoch, float(np.mean(losses)), float(valid), dropped))
            if best is None or valid <= best:
                best, waited = valid, 0
            else:
                waited += 1
                if waited >= PATIENCE:
                    break
            if scheduler is not None:
                learning_rate = scheduler(valid)
    finally:
        dealt.unpersist()
    losses = spark.createDataFrame(history, "epoch int, train_loss double, valid_loss double, dropped_windows bigint")
    return unpack(state.flat, weights), losses


def weights_table(spark: SparkSession, weights: Weights, run_id: str) -> DataFrame:
    """``weights(run_id, name, shape, values)`` (S-05)."""
    rows = [(run_id, n, list(w.shape), [float(v) for v in w.ravel()]) for n, w in weights.items()]
    return spark.createDataFrame(rows, "run_id string, name string, shape array<int>, values array<double>")


def weights_from_table(table: DataFrame, run_id: str) -> Weights:
    rows = table.where(F.col("run_id") == run_id).collect()
    return {r.name: np.array(r["values"], dtype=float).reshape(r["shape"]) for r in rows}
