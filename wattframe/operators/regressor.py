"""Linear multi-output regression on lagged windows (M-12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.timegrid import grid_time
from ..session import cut_lineage
from .blocks import join_per_key, sum_arrays
from .lagmodel import SERIES_KEY, lag_products
from .lags import indexed, with_lags
from .network import complete_windows, flat_blocks
from .toeplitz import WindowEquations
from .windows import WINDOW_BLOCK

# Up to so many columns the normal equations are solved at once; beyond, from lag products.
DIRECT_COLUMNS = 2_048
# Ends of runs of windows whose rows reach the driver; with more, each step is a pass over the data.
MAX_EDGES = 2_000


def _design(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x.reshape(len(x), -1)])


def _summed(blocks: DataFrame, part: Callable, shape: tuple[int, int], training_window: int, size: int, on_null: str) -> np.ndarray | None:
    """Sum of ``part(z, y)`` over all windows; tasks add theirs before anything is sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(shape), 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                for x, y, _ in complete_windows(row, training_window, size, on_null):
                    if len(x):
                        total += part(_design(x), y)
                        seen += len(x)
        if seen:
            yield pd.DataFrame({"line": np.arange(shape[0]), "sums": list(total)})

    partial = flat_blocks(blocks).mapInPandas(run, "line int, sums array<double>")
    lines = sum_arrays(partial, ["line"], "sums").orderBy("line").toArrow()
    return lines["sums"].combine_chunks().flatten().to_numpy().reshape(shape) if lines.num_rows else None


def _lag_sums(blocks: DataFrame, n_features: int, training_window: int, size: int, on_null: str) -> DataFrame:
    """Lag products of all windows, and where runs of windows begin and end: ``line, sums, area, block, at, sign``.

    Line ``j`` has the products ``j`` rows apart; the line after the last one the sums of the first rows and the
    number of windows. A run that goes on in the next block ends in one and begins in the other, at the same ``at``.
    """
    tw, columns = training_window, ["line", "sums", "area", "block", "at", "sign"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, first, n = np.zeros((tw + 1, n_features, n_features)), np.zeros(n_features), 0
        for batch in batches:
            edges = []
            for row in batch.itertuples(index=False):
                values = np.asarray(row.cells, dtype=float).reshape(-1, row.width)
                low, high = max(row.block * size, row.first), min((row.block + 1) * size - 1, row.last - tw)
                starts = np.arange(low, high + 1) - row.base
                missing = np.concatenate([[0], np.cumsum(~np.isfinite(values).all(axis=1))])
                whole = missing[starts + tw + 1] == missing[starts] if len(starts) else np.zeros(0, bool)
                if on_null == "error" and not whole.all():
                    raise ValueError(f"area {row.area} has windows with missing cells; fill them or pass on_null='drop'")
                steps = np.flatnonzero(np.diff(np.concatenate([[0], whole.astype(np.int8), [0]])))
                for a, b in steps.reshape(-1, 2).tolist():
                    a, b = int(starts[0]) + a, int(starts[0]) + b
                    for j in range(tw + 1):
                        products[j] += values[a:b].T @ values[a + j : b + j]
                    first, n = first + values[a:b].sum(0), n + b - a
                    edges += [(None, None, row.area, row.block, a + row.base, -1), (None, None, row.area, row.block, b + row.base, 1)]
            if edges:
                yield pd.DataFrame(edges, columns=columns)
        if n:
            lines = [*(p.ravel() for p in products), np.append(first, n)]
            yield pd.DataFrame({"line": range(len(lines)), "sums": lines, "area": None, "block": None, "at": None, "sign": None})

    return flat_blocks(blocks).mapInPandas(run, "line int, sums array<double>, area string, block bigint, at bigint, sign int")


def _edge_rows(blocks: DataFrame, edges: DataFrame, n_features: int, training_window: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``training_window`` rows from each edge on: of the beginnings, and of the ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                at = (row.at - row.base) * row.width
                rows.append((row.sign, np.asarray(row.cells, dtype=float)[at : at + training_window * row.width]))
            yield pd.DataFrame(rows, columns=["sign", "cells"])

    found = flat_blocks(blocks).join(edges, ["area", "block"]).mapInPandas(run, "sign int, cells array<double>").toArrow()
    cells = found["cells"].combine_chunks().flatten().to_numpy().reshape(-1, training_window, n_features)
    sign = found["sign"].to_numpy()
    return cells[sign < 0], cells[sign > 0]


def window_equations(
    blocks: DataFrame, n_features: int, training_window: int, size: int = WINDOW_BLOCK, on_null: str = "error"
) -> WindowEquations | None:
    """The normal equations of all windows, of one pass over ``blocks``; None where runs have more than ``MAX_EDGES`` ends.

    The driver gets ``training_window + 1`` matrices of F x F and ``training_window`` rows for each end of a run. A
    run is a stretch of an area's grid without missing cells; blocks don't break it.
    """
    sums = cut_lineage(_lag_sums(blocks, n_features, training_window, size, on_null))
    edges = sums.where("line IS NULL").groupBy("area", "at").agg(F.sum("sign").cast("int").alias("sign"), F.max("block").alias("block"))
    edges = cut_lineage(edges.where("sign <> 0"))
    if edges.count() > MAX_EDGES:
        return None
    lines = sum_arrays(sums.where("line IS NOT NULL").select("line", "sums"), ["line"], "sums").orderBy("line").toArrow()["sums"].to_pylist()
    if not lines:
        raise ValueError("no windows: the series are shorter than one window")
    products = np.array(lines[:-1]).reshape(training_window + 1, n_features, n_features)
    return WindowEquations(products, np.array(lines[-1][:-1]), lines[-1][-1], *_edge_rows(blocks, edges, n_features, training_window))


def fit_window_regressor(
    blocks: DataFrame, n_features: int, training_window: int, ridge: float = 0.0, size: int = WINDOW_BLOCK,
    on_null: str = "error", direct_columns: int = DIRECT_COLUMNS, tolerance: float = 1e-10, max_steps: int = 10_000,
) -> np.ndarray:
    """Coefficients float[1 + tw * F][F] of least squares.

    Up to ``direct_columns`` columns one pass sums the normal equations for all
    outputs. With more, one pass sums lag products, from which conjugate
    gradients on the driver solve them without further passes, until residuals
    have shrunk by ``tolerance`` (see ``toeplitz``); what reaches the driver has
    about the size of the coefficients. Only where missing cells break the grid
    into more than ``MAX_EDGES / 2`` runs each step is a pass. A window with a
    missing cell raises, or is left out with ``on_null='drop'``. Pass
    checkpointed blocks.
    """
    k = 1 + training_window * n_features

    def summed(part: Callable, width: int) -> np.ndarray:
        total = _summed(blocks, part, (k, width), training_window, size, on_null)
        if total is None:
            raise ValueError("no windows: the series are shorter than one window")
        return total

    if k <= direct_columns:
        matrix = summed(lambda z, y: z.T @ np.hstack([z, y]), k + n_features)
        return np.linalg.lstsq(matrix[:, :k] + ridge * np.eye(k), matrix[:, k:], rcond=1e-12)[0]
    equations = window_equations(blocks, n_features, training_window, size, on_null)
    if equations is not None:
        return equations.solve(ridge, tolerance, max_steps)
    residual = summed(lambda z, y: z.T @ y, n_features)
    beta, direction = np.zeros_like(residual), residual.copy()
    now = first = (residual**2).sum(0)
    for _ in range(max_steps):
        if (now <= tolerance**2 * np.maximum(first, 1e-300)).all():
            return beta
        image = summed(lambda z, y, d=direction: z.T @ (z @ d), n_features) + ridge * direction
        step = now / np.maximum((direction * image).sum(0), 1e-300)
        beta, residual = beta + step * direction, residual - step * image
        before, now = now, (residual**2).sum(0)
        direction = residual + now / np.maximum(before, 1e-300) * direction
    raise ValueError(f"no solution after {max_steps} steps; raise max_steps or the ridge")


def linear_scorer(beta: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Scorer for ``next_step_forecast`` and ``n_step_forecast``."""
    return lambda x: _design(x) @ beta


def series_lines(df: DataFrame, step: int, size: int = WINDOW_BLOCK) -> DataFrame:
    """``(area, series, intercept, slope)``: each series' value as a line of the one a step before, all in one grouped sum.

    A series without two different values in a row has null coefficients.
    """
    sums = lag_products(df, [1], step, size).select(*SERIES_KEY, *(F.col("products")[k].alias(c) for k, c in enumerate(("n", "x", "y", "xx", "xy"))))
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    lines = sums.withColumn("slope", slope)
    return lines.select(*SERIES_KEY, ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("intercept"), "slope")


def line_forecast(df: DataFrame, lines: DataFrame, step: int, size: int = WINDOW_BLOCK) -> DataFrame:
    """``(area, ts, series, value, predicted)`` of every row that has one a step before it; null after a missing value."""
    cells = indexed(df, step).withColumn("_cell", F.struct("value"))
    rows = with_lags(cells, [1], size, "_cell").where("lag_1 IS NOT NULL")
    scored = join_per_key(rows, lines, SERIES_KEY, F.col("idx"))
    predicted = F.col("intercept") + F.col("slope") * F.col("lag_1.value")
    return scored.select("area", grid_time(F.col("idx"), step).alias("ts"), "series", "value", predicted.alias("predicted"))
