"""Seasonal lag models fitted by least squares on sums that Spark adds up.

The estimator is the two-stage regression of Hannan and Rissanen (1982): a long
autoregression gives residuals, then the value is regressed on its own lags and
on residual lags, ordinary and seasonal. Its estimates are not the
maximum-likelihood ones; compare models by their forecast error.

Spark's part: series are cut into blocks with a halo, each task adds the cross
products ``Z'Z`` of its blocks, and the partial sums are added per series. The
36 candidate orders are sub-blocks of one such matrix per series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.timegrid import grid_index, grid_time
from .blocks import BLOCK_ROWS, join_per_key, sum_arrays, with_halo
from .lags import difference_weights

SERIES_KEY = ["area", "series"]
FLUSH_SERIES = 512
#: Series whose forecasts a task makes at a time.
FORECAST_SERIES = 256

MODEL_SCHEMA = (
    "area string, series string, p int, d int, q int, sp int, sd int, sq int, m int, step int, "
    "intercept double, ar_lags array<int>, ar_coef array<double>, ma_lags array<int>, ma_coef array<double>, "
    "long_coef array<double>, x_ar array<int>, x_ma array<int>, products array<double>, "
    "n bigint, sigma2 double, aic double, last_idx bigint"
)


@dataclass(frozen=True)
class Search:
    """Ranges of the orders to try, and the grid they live on.

    ``product`` multiplies the ordinary and the seasonal polynomial (see ``operators.seasonal``), which adds the
    lags between them; otherwise their lags stand side by side.
    """

    m: int = 24
    step: int = 3_600
    min_p: int = 1
    min_q: int = 1
    max_p: int = 3
    max_q: int = 3
    min_sp: int = 1
    min_sq: int = 1
    max_sp: int = 2
    max_sq: int = 2
    max_d: int = 2
    max_sd: int = 1
    long_lags: int | None = None
    block: int = BLOCK_ROWS
    product: bool = False

    def ar_lags(self) -> list[int]:
        return lag_set(self.max_p, self.max_sp, self.m, self.product)

    def ma_lags(self) -> list[int]:
        return lag_set(self.max_q, self.max_sq, self.m, self.product)

    def long_order(self) -> int:
        """Lags of the first-stage autoregression; by default it covers every lag of the second stage."""
        return self.long_lags or max(self.ar_lags() + self.ma_lags())

    def back(self) -> int:
        """Rows before a position that its regression row depends on."""
        return self.long_order() + max(self.ar_lags() + self.ma_lags()) + self.max_d + self.max_sd * self.m

    def candidates(self) -> list[tuple[int, int, int, int]]:
        return list(
            product(
                range(self.min_p, self.max_p + 1),
                range(self.min_q, self.max_q + 1),
                range(self.min_sp, self.max_sp + 1),
                range(self.min_sq, self.max_sq + 1),
            )
        )


def lag_set(order: int, seasonal: int, m: int, product: bool = False) -> list[int]:
    own, seasons = range(1, order + 1), [m * k for k in range(1, seasonal + 1)]
    return sorted({*own, *seasons, *(i + s for i in own for s in seasons if product)})


# ---------------------------------------------------------------- numpy helpers inside tasks


def differenced(y: np.ndarray, d: int, sd: int, m: int) -> np.ndarray:
    """Differences of a dense array; positions without a full history become NaN."""
    w = np.array(y, dtype=float)
    for lag in [1] * int(d) + [m] * int(sd):
        shifted = np.full_like(w, np.nan)
        shifted[lag:] = w[:-lag] if lag < len(w) else np.nan
        w = w - shifted
    return w


def lagged(w: np.ndarray, lags: list[int]) -> np.ndarray:
    """Column j holds ``w`` moved down by ``lags[j]``; NaN where it starts too late."""
    out = np.full((len(w), len(lags)), np.nan)
    for j, lag in enumerate(lags):
        if lag < len(w):
            out[lag:, j] = w[:-lag]
    return out


def long_residual(w: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Residual of the first-stage autoregression with intercept ``coef[0]``."""
    return w - coef[0] - lagged(w, list(range(1, len(coef)))) @ coef[1:]


def cross_products(z: np.ndarray) -> tuple[np.ndarray, int]:
    """``Z'Z`` over the rows without NaN, and their number."""
    z = z[np.isfinite(z).all(axis=1)]
    return z.T @ z, len(z)


def solve(products: np.ndarray, columns: list[int]) -> tuple[np.ndarray, float]:
    """Least squares of the last column on ``columns``: coefficients and residual sum of squares."""
    xx, xy = products[np.ix_(columns, columns)], products[columns, -1]
    # Columns of very different size would otherwise be cut off as if they were dependent.
    size = np.sqrt(np.diag(xx))
    size[size == 0] = 1
    beta = np.linalg.lstsq(xx / np.outer(size, size), xy / size, rcond=1e-12)[0] / size
    rss = products[-1, -1] - 2 * beta @ xy + beta @ xx @ beta
    return beta, max(float(rss), 0.0)


def _dense(idx: np.ndarray, value: np.ndarray, start: int, length: int) -> np.ndarray:
    y = np.full(length, np.nan)
    y[np.asarray(idx) - start] = np.asarray(value, dtype=float)
    return y


def _upper(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix))]


def _full(upper) -> np.ndarray:
    upper = np.asarray(upper, dtype=float)
    k = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
    matrix = np.zeros((k, k))
    matrix[np.triu_indices(k)] = upper
    return matrix + np.triu(matrix, 1).T


# ---------------------------------------------------------------- Spark side


def series_blocks(df: DataFrame, step: int, back: int, size: int = BLOCK_ROWS) -> DataFrame:
    """``(area, series, block, idx ARRAY, value ARRAY)``, at most ``size + back`` rows per block."""
    rows = df.where(F.col("value").isNotNull()).select(*SERIES_KEY, grid_index("ts", step).alias("idx"), "value")
    points = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return (
        with_halo(rows, "idx", size, back=back)
        .groupBy(*SERIES_KEY, "block")
        .agg(points.alias("_p"))
        .select(*SERIES_KEY, "block", F.col("_p.idx").alias("idx"), F.col("_p.value").alias("value"))
    )


def sum_products(blocks: DataFrame, design, size: int, back: int) -> DataFrame:
    """Adds ``Z'Z`` per series: ``(area, series, products ARRAY<DOUBLE>, n)``.

    ``design(row, y, start)`` builds Z for the dense array ``y`` that begins at
    grid position ``start``. Each task adds up what it has before anything is
    sent on; only the upper triangle and the number of rows travel.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], list] = {}

        def emit() -> pd.DataFrame:
            rows = [(a, s, np.append(_upper(g), n)) for (a, s), (g, n) in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=["area", "series", "products"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                start = row.block * size - back
                y = _dense(row.idx, row.value, start, size + back)
                gram, n = cross_products(design(row, y, start)[back:])
                have = sums.get((row.area, row.series))
                sums[(row.area, row.series)] = [gram, n] if have is None else [have[0] + gram, have[1] + n]
            if len(sums) >= FLUSH_SERIES:
                yield emit()
        if sums:
            yield emit()

    partials = blocks.mapInPandas(partial, "area string, series string, products array<double>")
    total = sum_arrays(partials, SERIES_KEY, "products")
    return total.select(
        *SERIES_KEY,
        F.slice("products", F.lit(1), F.size("products") - 1).alias("products"),
        F.element_at("products", -1).cast("bigint").alias("n"),
    )


def lag_products(df: DataFrame, lag_list: list[int], step: int = 3_600, size: int = BLOCK_ROWS) -> DataFrame:
    """Cross products of constant, lags and value per series, upper triangle row by row."""
    back = max(lag_list)

    def design(row, y, start):
        return np.column_stack([np.ones(len(y)), lagged(y, lag_list), y])

    return sum_products(series_blocks(df, step, back, size), design, size, back)


def _checked_orders(orders: DataFrame, search: Search) -> DataFrame:
    """Orders beyond the search's maximum would need a longer halo."""
    message = F.lit("differencing order above max_d or max_sd of the search")
    fits = (F.col("d") <= search.max_d) & (F.col("sd") <= search.max_sd)
    return orders.withColumn("d", F.when(fits, F.col("d")).otherwise(F.raise_error(message).cast("int")))


def _checked_models(models: DataFrame, search: Search) -> DataFrame:
    """Stored models must come from the same lag sets."""
    message = F.lit("the stored models come from another search")
    same = (
        (F.col("m") == search.m)
        & (F.col("step") == search.step)
        & (F.col("x_ar") == F.array(*[F.lit(k) for k in search.ar_lags()]))
        & (F.col("x_ma") == F.array(*[F.lit(k) for k in search.ma_lags()]))
        & (F.size("long_coef") == search.long_order() + 1)
    )
    return models.withColumn("d", F.when(same, F.col("d")).otherwise(F.raise_error(message).cast("int")))


def long_autoregression(blocks: DataFrame, orders: DataFrame, search: Search) -> DataFrame:
    """First stage: ``(area, series, d, sd, long_coef)``."""
    lags, m = list(range(1, search.long_order() + 1)), search.m
    orders = _checked_orders(orders, search)

    def design(row, y, start):
        w = differenced(y, row.d, row.sd, m)
        return np.column_stack([np.ones(len(w)), lagged(w, lags), w])

    with_orders = join_per_key(blocks, orders.select(*SERIES_KEY, "d", "sd"), SERIES_KEY, F.col("block"))
    sums = sum_products(with_orders, design, search.block, search.back())

    def coefficients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrices = [_full(p) for p in batch["products"]]
            fitted = [solve(g, list(range(len(g) - 1)))[0] for g in matrices]
            yield batch[SERIES_KEY].assign(long_coef=fitted)

    fitted = sums.mapInPandas(coefficients, "area string, series string, long_coef array<double>")
    message = F.concat(F.lit("no rows to fit a model of "), F.col("area"), F.lit("/"), F.col("series"))
    known = F.when(F.col("long_coef").isNull(), F.raise_error(message).cast("array<double>")).otherwise(F.col("long_coef"))
    return orders.join(fitted, SERIES_KEY, "left").withColumn("long_coef", known)


def second_stage(blocks: DataFrame, first: DataFrame, search: Search) -> DataFrame:
    """Cross products of value lags, residual lags and value: ``(area, series, products, n)``.

    ``first`` carries ``d, sd, long_coef`` and ``after``: only positions later
    than ``after`` are added (null = all of them).
    """
    ar, ma, m = search.ar_lags(), search.ma_lags(), search.m

    def design(row, y, start):
        w = differenced(y, row.d, row.sd, m)
        e = long_residual(w, np.asarray(row.long_coef, dtype=float))
        z = np.column_stack([np.ones(len(w)), lagged(w, ar), lagged(e, ma), w])
        if not pd.isna(row.after):
            z[start + np.arange(len(w)) <= row.after] = np.nan
        return z

    needed = first.select(*SERIES_KEY, "d", "sd", "long_coef", "after")
    with_first = join_per_key(blocks, needed, SERIES_KEY, F.col("block"))
    return sum_products(with_first, design, search.block, search.back())


def _model_row(row, candidates, search: Search) -> dict:
    """Best candidate for one series by AIC."""
    gram = _full(row.products)
    x_ar, x_ma = search.ar_lags(), search.ma_lags()
    best = None
    for p, q, sp, sq in candidates:
        ar, ma = lag_set(p, sp, search.m), lag_set(q, sq, search.m)
        columns = [0, *(1 + x_ar.index(k) for k in ar), *(1 + len(x_ar) + x_ma.index(k) for k in ma)]
        beta, rss = solve(gram, columns)
        n = int(row.n)
        if n <= len(columns):
            continue
        sigma2 = rss / n
        aic = n * float(np.log(max(sigma2, 1e-300))) + 2 * (len(beta) + 1)
        if best is None or aic < best["aic"]:
            best = {
                "p": p, "q": q, "sp": sp, "sq": sq,
                "intercept": float(beta[0]),
                "ar_lags": ar, "ar_coef": beta[1 : 1 + len(ar)],
                "ma_lags": ma, "ma_coef": beta[1 + len(ar) :],
                "sigma2": sigma2, "aic": aic,
            }
    if best is None:
        raise ValueError(f"too few values for a model of {row.area}/{row.series}: {int(row.n)} rows")
    return {
        "area": row.area, "series": row.series, "d": int(row.d), "sd": int(row.sd),
        "m": search.m, "step": search.step, "long_coef": row.long_coef,
        "x_ar": x_ar, "x_ma": x_ma, "products": row.products, "n": int(row.n),
        "last_idx": int(row.last_idx), **best,
    }


def choose(sums: DataFrame, search: Search, fixed_orders: bool) -> DataFrame:
    """Solve the candidates of each series and keep the best one."""
    columns = [field.split()[0] for field in MODEL_SCHEMA.split(", ")]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own = [(row.p, row.q, row.sp, row.sq)] if fixed_orders else search.candidates()
                rows.append(_model_row(row, own, search))
            yield pd.DataFrame(rows, columns=columns)

    return sums.mapInPandas(pick, MODEL_SCHEMA)


def _last_index(df: DataFrame, step: int) -> DataFrame:
    known = df.where(F.col("value").isNotNull())
    return known.groupBy(*SERIES_KEY).agg(F.max(grid_index("ts", step)).alias("last_idx"))


def fit_new(df: DataFrame, orders: DataFrame, search: Search) -> DataFrame:
    """Search all candidate orders for every series at once (M-04).

    ``orders(area, series, d, sd)`` holds the differencing orders.
    """
    blocks = series_blocks(df, search.step, search.back(), search.block)
    first = long_autoregression(blocks, orders, search).withColumn("after", F.lit(None).cast("bigint"))
    sums = second_stage(blocks, first, search)
    described = sums.join(first, SERIES_KEY).join(_last_index(df, search.step), SERIES_KEY)
    return choose(described, search, fixed_orders=False)


def refit(df: DataFrame, models: DataFrame, search: Search) -> DataFrame:
    """Refit each stored model with its own orders on the given data (M-05)."""
    blocks = series_blocks(df, search.step, search.back(), search.block)
    orders = models.select(*SERIES_KEY, "p", "d", "q", "sp", "sd", "sq")
    first = long_autoregression(blocks, orders, search).withColumn("after", F.lit(None).cast("bigint"))
    sums = second_stage(blocks, first, search)
    described = sums.join(first, SERIES_KEY).join(_last_index(df, search.step), SERIES_KEY)
    return choose(described, search, fixed_orders=True)


def update(df: DataFrame, models: DataFrame, search: Search) -> DataFrame:
    """Add new observations to each stored model (M-06).

    ``df`` holds the new rows and at least ``search.back()`` rows before them.
    The stored cross products get those of the rows after ``last_idx`` added;
    the first-stage coefficients stay as they are until the next refit.
    """
    models = _checked_models(models, search)
    reach = models.select(*SERIES_KEY, F.col("last_idx").alias("_until"))
    rows = df.withColumn("_idx", grid_index("ts", search.step))
    recent = join_per_key(rows, reach, SERIES_KEY, F.col("_idx")).where(
        F.col("_idx") > F.col("_until") - search.back()
    )
    blocks = series_blocks(recent, search.step, search.back(), search.block)
    first = models.withColumn("after", F.col("last_idx"))
    added = second_stage(blocks, first, search).select(
        *SERIES_KEY, F.col("products").alias("_more"), F.col("n").alias("_new")
    )
    seen = _last_index(recent, search.step).withColumnRenamed("last_idx", "_seen")
    kept = models.join(added, SERIES_KEY, "left").join(seen, SERIES_KEY, "left")
    total = F.when(
        F.col("_more").isNull(), F.col("products")
    ).otherwise(F.zip_with("products", "_more", lambda a, b: a + b))
    described = kept.select(
        *SERIES_KEY, "p", "d", "q", "sp", "sd", "sq", "long_coef",
        total.alias("products"),
        (F.col("n") + F.coalesce("_new", F.lit(0))).alias("n"),
        F.greatest("last_idx", "_seen").alias("last_idx"),
    )
    return choose(described, search, fixed_orders=True)


# ---------------------------------------------------------------- forecasts


def _padded(lists: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Lags and coefficients of several series as two equally wide tables; what is missing is a lag of 1 with the coefficient 0."""
    width = max((len(lags) for lags, _ in lists), default=0)
    lags, coef = np.ones((len(lists), width), np.int64), np.zeros((len(lists), width))
    for i, (own, c) in enumerate(lists):
        lags[i, : len(own)], coef[i, : len(own)] = own, c
    return lags, coef


def predict_paths(models: list, y: np.ndarray, steps: int) -> np.ndarray:
    """Values after the end of each row of ``y``, one model a row: the recursion of all series at once, future shocks at zero."""
    n = y.shape[1]
    w, e, path = (np.zeros((len(y), n + steps)) for _ in range(3))
    path[:, :n] = y
    for i, model in enumerate(models):
        w[i, :n] = differenced(y[i], model.d, model.sd, model.m)
        e[i, :n] = long_residual(w[i, :n], np.asarray(model.long_coef, dtype=float))
    ar = _padded([(m.ar_lags, m.ar_coef) for m in models])
    ma = _padded([(m.ma_lags, m.ma_coef) for m in models])
    weights = [{k: c for k, c in difference_weights(int(m.d), int(m.sd), int(m.m)).items() if k} for m in models]
    back = _padded([(list(x), list(x.values())) for x in weights])
    level, rows = np.array([m.intercept for m in models]), np.arange(len(y))[:, None]
    for t in range(n, n + steps):
        w[:, t] = level + (w[rows, t - ar[0]] * ar[1]).sum(1) + (e[rows, t - ma[0]] * ma[1]).sum(1)
        path[:, t] = w[:, t] - (path[rows, t - back[0]] * back[1]).sum(1)
    return path[:, n:]


def forecast(
    df: DataFrame, models: DataFrame, start: str, end: str, search: Search, any_start: bool = False
) -> DataFrame:
    """``forecast(area, ts, series, predicted)`` from ``start`` to ``end``, both included (M-07, G-01).

    Steps always begin right after the data a model has seen. A ``start`` that
    is not that point raises, unless ``any_start`` says the dates are labels
    only. Only the last ``search.back()`` rows of a series reach its task, as
    one array, and a task runs the recursion of a whole batch of series at once.
    """
    step, back = search.step, search.back() + 1
    first = int(pd.Timestamp(start).timestamp()) // step
    steps = int(pd.Timestamp(end).timestamp()) // step - first + 1
    ends = models.select(*SERIES_KEY, "last_idx")
    rows = df.where(F.col("value").isNotNull()).select(*SERIES_KEY, grid_index("ts", step).alias("idx"), "value")
    near = (F.col("idx") > F.col("last_idx") - back) & (F.col("idx") <= F.col("last_idx"))
    tails = join_per_key(rows, ends, SERIES_KEY, F.col("idx")).where(near)
    tails = tails.groupBy(*SERIES_KEY).agg(F.collect_list("idx").alias("_idx"), F.collect_list("value").alias("_value"))
    needed = models.select(*SERIES_KEY, "d", "sd", "m", "intercept", "ar_lags", "ar_coef", "ma_lags", "ma_coef", "long_coef", "last_idx")
    # a batch of series for each task, not one each
    joined = needed.join(tails, SERIES_KEY, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), FORECAST_SERIES):
                batch = list(whole.iloc[k : k + FORECAST_SERIES].rename(columns={"_idx": "tail_idx", "_value": "tail"}).itertuples(index=False))
                for own in batch:
                    if own.tail is None:
                        raise ValueError(f"no data for the model of {own.area}/{own.series}")
                    if not any_start and first != own.last_idx + 1:
                        raise ValueError(f"the forecast of {own.series} must start right after its data")
                y = np.array([_dense(own.tail_idx, own.tail, own.last_idx - back + 1, back) for own in batch])
                paths = predict_paths(batch, y, steps)
                for own, path in zip(batch, paths):
                    if not np.isfinite(path).all():
                        raise ValueError(f"a gap in the last {back} steps of {own.area}/{own.series}; fill it before forecasting")
                yield pd.DataFrame({
                    "area": np.repeat([own.area for own in batch], steps), "series": np.repeat([own.series for own in batch], steps),
                    "idx": np.tile(first + np.arange(steps), len(batch)), "predicted": paths.ravel(),
                })

    scored = joined.mapInPandas(run, "area string, series string, idx bigint, predicted double")
    return scored.select("area", grid_time(F.col("idx"), step).alias("ts"), "series", "predicted")


def fitted_values(df: DataFrame, models: DataFrame, search: Search) -> DataFrame:
    """One-step-ahead values inside the data: ``(area, ts, series, value, predicted)`` (M-08)."""
    size, back, m = search.block, search.back(), search.m
    blocks = series_blocks(df, search.step, back, size)
    needed = models.select(
        *SERIES_KEY, "d", "sd", "long_coef", "intercept", "ar_lags", "ar_coef", "ma_lags", "ma_coef"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                start = row.block * size - back
                y = _dense(row.idx, row.value, start, size + back)
                w = differenced(y, row.d, row.sd, m)
                e = long_residual(w, np.asarray(row.long_coef, dtype=float))
                step = row.intercept + lagged(w, list(row.ar_lags)) @ np.asarray(row.ar_coef, dtype=float)
                step = step + lagged(e, list(row.ma_lags)) @ np.asarray(row.ma_coef, dtype=float)
                fitted = y - (w - step)
                at = np.arange(back, back + size)
                at = at[np.isfinite(y[at])]
                yield pd.DataFrame(
                    {"area": row.area, "series": row.series, "idx": start + at, "value": y[at],
                     "predicted": fitted[at]}
                )

    joined = join_per_key(blocks, needed, SERIES_KEY, F.col("block"))
    return joined.mapInPandas(
        run, "area string, series string, idx bigint, value double, predicted double"
    ).select("area", grid_time(F.col("idx"), search.step).alias("ts"), "series", "value", "predicted")


# ---------------------------------------------------------------- seasonal differencing order


def ocsb_critical(m: int) -> float:
    """Critical value of the test at 5 % for a season of ``m``.

    The smooth formula in m that the open-source forecast package for R publishes (``calcOCSBCritVal``).
    """
    # Coefficients of that formula.
    scale, slope, square, centre, limit = -0.2937411, -0.2850853, -0.05983644, 0.7656451, -1.652202
    x = np.log(m) - centre
    return float(scale * np.exp(slope * x + square * x * x) + limit)


def seasonal_order(
    df: DataFrame, m: int, critical: float | None = None, step: int = 3_600, lags: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """``(area, series, t_stat, sd)``: is a seasonal difference of lag ``m`` needed? (M-02)

    The regression of Osborn, Chui, Smith and Birchenhall (1988): the first and
    seasonal difference on ``lags`` of itself, on the seasonal difference one
    step back and on the first difference ``m`` steps back. ``sd`` is 1 where
    the t-statistic of the last one lies above ``critical``, by default that of
    :func:`ocsb_critical`.
    """
    critical = ocsb_critical(m) if critical is None else critical
    back = 2 * m + lags + 2

    def design(row, y, start):
        w = differenced(y, 1, 1, m)
        parts = [lagged(w, list(range(1, lags + 1)))] if lags else []
        parts += [lagged(differenced(y, 0, 1, m), [1]), lagged(differenced(y, 1, 0, m), [m]), w[:, None]]
        return np.column_stack(parts)

    blocks = series_blocks(df, step, back, size)
    sums = sum_products(blocks, design, size, back)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = []
            for row in batch.itertuples(index=False):
                gram = _full(row.products)
                columns = list(range(len(gram) - 1))
                beta, rss = solve(gram, columns)
                free = row.n - len(columns)
                spread = np.linalg.pinv(gram[:-1, :-1])[-1, -1] * rss / free if free > 0 else 0.0
                stats.append(float(beta[-1] / np.sqrt(spread)) if spread > 0 else None)
            yield batch[SERIES_KEY].assign(t_stat=stats)

    tested = sums.mapInPandas(test, "area string, series string, t_stat double")
    return tested.withColumn("sd", F.coalesce((F.col("t_stat") > critical).cast("int"), F.lit(0)))
