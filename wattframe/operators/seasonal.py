"""Multiplicative seasonal models, fitted on sums of lag products.

``(1 - phi(B)) (1 - Phi(B^m)) w = c + (1 + theta(B)) (1 + Theta(B^m)) e`` on the differenced series ``w``.

One pass over the data adds up, per series, the products of ``w`` with its own lags. Everything else is algebra on
that matrix: the long autoregression that stands for the shocks ``e``, the products with lagged shocks (a shock is
``w`` less a sum of its lags), and Gauss-Newton steps for the factors, whose normal equations are ``J'GJ`` with the
Jacobian ``J`` of the expanded lag coefficients. No step reads the data again. New rows add their products, so an
updated model is the one that all rows would give, shocks included.

A model row has the expanded lags and coefficients, so forecasts and fitted values are those of ``lagmodel``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.timegrid import grid_index
from .blocks import join_per_key
from .lagmodel import (
    MODEL_SCHEMA, SERIES_KEY, Search, _checked_models, _checked_orders, _full, _last_index, differenced, lag_set, lagged,
    series_blocks, solve, sum_products,
)

FACTORS = ("ar_factor", "seasonal_ar_factor", "ma_factor", "seasonal_ma_factor")
SCHEMA = MODEL_SCHEMA + "".join(f", {name} array<double>" for name in FACTORS)
MAX_STEPS = 50
#: A search goes on while a step lowers the sum of squares by more than this share.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Orders:
    """Numbers of factors: ordinary and seasonal, of values and of shocks."""

    p: int
    q: int
    sp: int
    sq: int
    m: int

    def parts(self) -> list[int]:
        """Ends of the constant and the four groups of factors in a vector of all."""
        return np.cumsum([1, self.p, self.sp, self.q, self.sq]).tolist()


def expand(factors: np.ndarray, orders: Orders, x_ar: list[int], x_ma: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of constant, value lags and shock lags, and their derivatives by the factors."""
    ends = orders.parts()
    size = 1 + len(x_ar) + len(x_ma)
    out, by = np.zeros(size), np.zeros((size, len(factors)))
    out[0], by[0, 0] = factors[0], 1
    sides = ((x_ar, 1, ends[0], ends[1], ends[2], -1), (x_ma, 1 + len(x_ar), ends[2], ends[3], ends[4], 1))
    for lags, offset, first, middle, last, sign in sides:
        at = lambda lag: offset + lags.index(lag)  # noqa: B023, E731
        own = [(k - first + 1, k) for k in range(first, middle)]
        seasons = [(orders.m * (k - middle + 1), k) for k in range(middle, last)]
        for lag, k in own + seasons:
            out[at(lag)] += factors[k]
            by[at(lag), k] += 1
        for i, a in own:
            for s, b in seasons:
                out[at(i + s)] += sign * factors[a] * factors[b]
                by[at(i + s), a] += sign * factors[b]
                by[at(i + s), b] += sign * factors[a]
    return out, by


def squares(gram: np.ndarray, coef: np.ndarray) -> float:
    """Sum of squared errors of the last column for these coefficients of the others."""
    return float(gram[-1, -1] - 2 * coef @ gram[:-1, -1] + coef @ gram[:-1, :-1] @ coef)


def gauss_newton(
    gram: np.ndarray, start: np.ndarray, orders: Orders, x_ar: list[int], x_ma: list[int], steps: int = MAX_STEPS
) -> tuple[np.ndarray, float]:
    """Factors that minimise the squares, by at most ``steps`` steps from ``start``, and their sum of squares.

    A step that does not lower the sum is halved.
    """
    factors = np.array(start, dtype=float)
    coef, by = expand(factors, orders, x_ar, x_ma)
    now = squares(gram, coef)
    for _ in range(steps):
        open_ = gram[:-1, -1] - gram[:-1, :-1] @ coef
        right = by.T @ open_
        normal = np.block([[by.T @ gram[:-1, :-1] @ by, right[:, None]], [right[None, :], np.zeros((1, 1))]])
        step, _ = solve(normal, list(range(len(factors))))
        share = 1.0
        while True:
            tried = factors + share * step
            coef_tried, by_tried = expand(tried, orders, x_ar, x_ma)
            after = squares(gram, coef_tried)
            if after <= now or share < 1e-6:
                break
            share /= 2
        if after > now:
            break
        gain, factors, coef, by, now = now - after, tried, coef_tried, by_tried, after
        if gain <= TOLERANCE * abs(now):
            break
    return factors, max(now, 0.0)


# ---- sums ----


def reach(search: Search) -> int:
    """Lags of the products: those of the shocks' own long autoregression, from the last shock on."""
    return max(search.long_order() + max(search.ma_lags(), default=0), max(search.ar_lags(), default=0))


def moments(blocks: DataFrame, orders: DataFrame, search: Search) -> DataFrame:
    """Products of constant, ``w`` and its lags up to :func:`reach`: ``(area, series, products, n)``.

    ``orders`` has ``d, sd`` and ``after``; only rows later than ``after`` count (null: all). One pass, whatever the
    number of candidates or steps.
    """
    lags, m = list(range(reach(search) + 1)), search.m

    def design(row, y, start):
        w = differenced(y, row.d, row.sd, m)
        z = np.column_stack([np.ones(len(w)), w, lagged(w, lags[1:])])
        if not pd.isna(row.after):
            z[start + np.arange(len(w)) <= row.after] = np.nan
        return z

    needed = _checked_orders(orders, search).select(*SERIES_KEY, "d", "sd", "after")
    with_orders = join_per_key(blocks, needed, SERIES_KEY, F.col("block"))
    return sum_products(with_orders, design, search.block, _back(search))


def _back(search: Search) -> int:
    return reach(search) + search.max_d + search.max_sd * search.m


def long_autoregression(products: np.ndarray, length: int) -> np.ndarray:
    """Constant and coefficients of ``w`` on its first ``length`` lags."""
    columns = [0, *range(2, length + 2), 1]
    return solve(products[np.ix_(columns, columns)], list(range(length + 1)))[0]


def shock_products(products: np.ndarray, long_coef: np.ndarray, x_ar: list[int], x_ma: list[int]) -> np.ndarray:
    """Products of constant, value lags, shock lags and ``w``, from those of ``w``."""
    rows = np.zeros((2 + len(x_ar) + len(x_ma), len(products)))
    rows[0, 0] = rows[-1, 1] = 1
    for j, lag in enumerate(x_ar, 1):
        rows[j, 1 + lag] = 1
    for j, lag in enumerate(x_ma, 1 + len(x_ar)):
        rows[j, 0] = -long_coef[0]
        rows[j, 1 + lag] = 1
        rows[j, 2 + lag : 1 + lag + len(long_coef)] -= long_coef[1:]
    return rows @ products @ rows.T


def _start(gram: np.ndarray, orders: Orders, x_ar: list[int], x_ma: list[int]) -> np.ndarray:
    """Factors as if the lags stood side by side."""
    columns = [0, *(1 + x_ar.index(k) for k in range(1, orders.p + 1)), *(1 + x_ar.index(orders.m * k) for k in range(1, orders.sp + 1))]
    columns += [1 + len(x_ar) + x_ma.index(k) for k in range(1, orders.q + 1)]
    columns += [1 + len(x_ar) + x_ma.index(orders.m * k) for k in range(1, orders.sq + 1)]
    return solve(gram, columns)[0]


def _model(row, candidates, search: Search) -> dict:
    """The candidate with the least AIC for one series."""
    products, x_ar, x_ma, n = _full(row.products), search.ar_lags(), search.ma_lags(), int(row.n)
    if n <= search.long_order() + 1:
        raise ValueError(f"too few values for a model of {row.area}/{row.series}: {n} rows")
    long_coef = long_autoregression(products, search.long_order())
    gram = shock_products(products, long_coef, x_ar, x_ma)
    best = None
    for p, q, sp, sq in candidates:
        orders = Orders(int(p), int(q), int(sp), int(sq), search.m)
        factors, rss = gauss_newton(gram, _start(gram, orders, x_ar, x_ma), orders, x_ar, x_ma)
        if n <= len(factors):
            continue
        aic = n * float(np.log(max(rss / n, 1e-300))) + 2 * (len(factors) + 1)
        if best is None or aic < best[0]:
            best = aic, orders, factors, rss
    if best is None:
        raise ValueError(f"too few values for a model of {row.area}/{row.series}: {n} rows")
    aic, orders, factors, rss = best
    coef, _ = expand(factors, orders, x_ar, x_ma)
    ar, ma = lag_positions(orders, x_ar, x_ma)
    groups = np.split(factors[1:], np.array(orders.parts()[1:-1]) - 1)
    return {
        "area": row.area, "series": row.series, "p": orders.p, "d": int(row.d), "q": orders.q, "sp": orders.sp, "sd": int(row.sd),
        "sq": orders.sq, "m": search.m, "step": search.step, "intercept": float(coef[0]),
        "ar_lags": [x_ar[j] for j in ar], "ar_coef": coef[1:][ar], "ma_lags": [x_ma[j] for j in ma], "ma_coef": coef[1 + len(x_ar) :][ma],
        "long_coef": long_coef, "x_ar": x_ar, "x_ma": x_ma, "products": row.products, "n": n, "sigma2": rss / n, "aic": aic,
        "last_idx": int(row.last_idx), "ar_factor": groups[0], "seasonal_ar_factor": groups[1], "ma_factor": groups[2],
        "seasonal_ma_factor": groups[3],
    }


def lag_positions(orders: Orders, x_ar: list[int], x_ma: list[int]) -> tuple[list[int], list[int]]:
    """Where the lags of these orders are in the search's lags."""
    ar, ma = lag_set(orders.p, orders.sp, orders.m, True), lag_set(orders.q, orders.sq, orders.m, True)
    return [x_ar.index(k) for k in ar], [x_ma.index(k) for k in ma]


def choose(sums: DataFrame, search: Search, fixed_orders: bool) -> DataFrame:
    columns = [field.split()[0] for field in SCHEMA.split(", ")]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own = [(row.p, row.q, row.sp, row.sq)] if fixed_orders else search.candidates()
                rows.append(_model(row, own, search))
            yield pd.DataFrame(rows, columns=columns)

    return sums.mapInPandas(pick, SCHEMA)


# ---- fit, refit, update ----


def _check(search: Search) -> None:
    if not search.product:
        raise ValueError("multiplicative models need Search(product=True)")


def _described(df: DataFrame, orders: DataFrame, search: Search) -> DataFrame:
    blocks = series_blocks(df, search.step, _back(search), search.block)
    sums = moments(blocks, orders.withColumn("after", F.lit(None).cast("bigint")), search)
    with_orders = orders.join(sums, SERIES_KEY, "left").join(_last_index(df, search.step), SERIES_KEY, "left")
    message = F.concat(F.lit("too few values for a model of "), F.col("area"), F.lit("/"), F.col("series"), F.lit(": no row with all lags"))
    return with_orders.withColumn("products", F.when(F.col("products").isNull(), F.raise_error(message).cast("array<double>"))
                                  .otherwise(F.col("products")))


def fit_new(df: DataFrame, orders: DataFrame, search: Search) -> DataFrame:
    """Search all candidate orders of every series (M-04); ``orders`` is ``(area, series, d, sd)``."""
    _check(search)
    return choose(_described(df, orders, search), search, fixed_orders=False)


def refit(df: DataFrame, models: DataFrame, search: Search) -> DataFrame:
    """Each stored model with its own orders on the given data (M-05)."""
    _check(search)
    return choose(_described(df, models.select(*SERIES_KEY, "p", "d", "q", "sp", "sd", "sq"), search), search, fixed_orders=True)


def update(df: DataFrame, models: DataFrame, search: Search) -> DataFrame:
    """Each stored model with the rows after its last one added: what :func:`refit` gives on all rows (M-06).

    ``df`` has the new rows and those before them that their lags reach, at least.
    """
    _check(search)
    models = _checked_models(models, search)
    last = models.select(*SERIES_KEY, F.col("last_idx").alias("_until"))
    rows = df.withColumn("_idx", grid_index("ts", search.step))
    recent = join_per_key(rows, last, SERIES_KEY, F.col("_idx")).where(F.col("_idx") > F.col("_until") - _back(search))
    blocks = series_blocks(recent, search.step, _back(search), search.block)
    added = moments(blocks, models.withColumn("after", F.col("last_idx")), search)
    added = added.select(*SERIES_KEY, F.col("products").alias("_more"), F.col("n").alias("_new"))
    seen = _last_index(recent, search.step).withColumnRenamed("last_idx", "_seen")
    kept = models.join(added, SERIES_KEY, "left").join(seen, SERIES_KEY, "left")
    total = F.when(F.col("_more").isNull(), F.col("products")).otherwise(F.zip_with("products", "_more", lambda a, b: a + b))
    described = kept.select(
        *SERIES_KEY, "p", "d", "q", "sp", "sd", "sq", total.alias("products"),
        (F.col("n") + F.coalesce("_new", F.lit(0))).alias("n"), F.greatest("last_idx", "_seen").alias("last_idx"))
    return choose(described, search, fixed_orders=True)


def factors_after(df: DataFrame, orders: DataFrame, search: Search, start: list[float], steps: int) -> DataFrame:
    """Factors of the largest orders after ``steps`` steps from ``start``: ``(area, series, n, factors, sigma2)``."""
    _check(search)
    orders_ = Orders(search.max_p, search.max_q, search.max_sp, search.max_sq, search.m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x_ar, x_ma = search.ar_lags(), search.ma_lags()
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                products = _full(row.products)
                gram = shock_products(products, long_autoregression(products, search.long_order()), x_ar, x_ma)
                factors, rss = gauss_newton(gram, np.array(start), orders_, x_ar, x_ma, steps)
                rows.append((row.area, row.series, int(row.n), factors, rss / row.n))
            yield pd.DataFrame(rows, columns=["area", "series", "n", "factors", "sigma2"])

    return _described(df, orders, search).mapInPandas(run, "area string, series string, n bigint, factors array<double>, sigma2 double")
