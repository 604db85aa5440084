"""Lags, differences and stationarity on the regular grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timegrid import grid_index, grid_time
from .blocks import BLOCK_ROWS, join_per_key, with_halo

# Fixed value: 5 % point of the level-stationarity test (KPSS 1992).
KPSS_CRITICAL_5 = 0.463


def indexed(df: DataFrame, step: int) -> DataFrame:
    """``(area, series, idx, value)`` with the arithmetic row index."""
    return df.select("area", "series", grid_index("ts", step).alias("idx"), "value")


def with_lags(df: DataFrame, lags: list[int], size: int = BLOCK_ROWS, column: str = "value") -> DataFrame:
    """Adds ``lag_k`` for each k: the value exactly k grid positions earlier, else null.

    ``df`` has ``area, series, idx`` and ``column``. All lags share one shuffle
    and one sort inside blocks with a halo of ``max(lags)`` rows.
    """
    halo = with_halo(df, "idx", size, back=max(lags))
    order = Window.partitionBy("area", "series", "block").orderBy("idx")
    added = {f"lag_{k}": F.first(column).over(order.rangeBetween(-k, -k)) for k in lags}
    return halo.withColumns(added).where("core").drop("block", "core")


def persistence(df: DataFrame, step: int = 3_600, size: int = BLOCK_ROWS) -> DataFrame:
    """Forecast = the value one step earlier (D-01)."""
    rows = with_lags(indexed(df, step), [1], size)
    return rows.select("area", grid_time(F.col("idx"), step).alias("ts"), "series", "value",
                       F.col("lag_1").alias("predicted"))


def difference_weights(order: int, seasonal: int, m: int) -> dict[int, int]:
    """Coefficients of ``(1 - B)^order (1 - B^m)^seasonal`` by lag."""
    poly = {0: 1}
    for lag in [1] * order + [m] * seasonal:
        longer = dict(poly)
        for k, c in poly.items():
            longer[k + lag] = longer.get(k + lag, 0) - c
        poly = longer
    return poly


def difference(
    df: DataFrame, order: int = 1, seasonal: int = 0, m: int = 24, step: int = 3_600, size: int = BLOCK_ROWS
) -> DataFrame:
    """First differences of ``order`` and seasonal ones of lag ``m``; null where a term is missing (M-03)."""
    poly = difference_weights(order, seasonal, m)
    lags = [k for k in poly if k > 0]
    rows = indexed(df, step)
    total: Column = F.col("value")
    if lags:
        rows = with_lags(rows, lags, size)
        for k in lags:
            total = total + poly[k] * F.col(f"lag_{k}")
    return rows.select("area", grid_time(F.col("idx"), step).alias("ts"), "series", total.alias("value"))


def truncation(n: int) -> int:
    """Lags of the long-run variance of ``n`` values: 12 (n / 100)^(1/4), as in KPSS (1992)."""
    return int(12 * (n / 100) ** 0.25)


def kpss(df: DataFrame, lags: int | None, keys: list[str], size: int = BLOCK_ROWS) -> DataFrame:
    """Level-stationarity statistic per key: ``(*keys, n, kpss)`` (M-01).

    Without a number of ``lags`` each key has its own, by :func:`truncation`.

    ``df`` has ``keys``, ``idx`` and ``x`` without nulls. The partial sums run
    over the whole series; each block reports its own sums, and the offset of a
    block - the sum of all blocks before - enters by algebra:
    ``sum((C + s)^2) = n C^2 + 2 C sum(s) + sum(s^2)``. The long-run variance
    weighs the products ``j`` steps apart by ``1 - j / (l + 1)``, which is the
    sum of squares of all moving sums of ``l + 1`` steps, divided by ``l + 1``:
    differences of prefix sums, so the plan is the same for any ``l``. A block
    has the ``l`` steps before it as a halo, and those after a series' last row
    belong to the block they lie in.
    """
    own_lags = F.floor(12 * F.pow(F.count("x") / 100, F.lit(0.25))) if lags is None else F.lit(lags)
    means = df.groupBy(*keys).agg(F.avg("x").alias("_mean"), own_lags.cast("bigint").alias("_l"))
    centred = join_per_key(df, means, keys, F.col("idx")).select(*keys, "idx", "_l", (F.col("x") - F.col("_mean")).alias("e"))
    halo = with_halo(centred, "idx", size, back=F.col("_l"))
    points = F.array_sort(F.collect_list(F.struct("idx", "e")))
    arrays = halo.groupBy(*keys, "block").agg(F.max("_l").alias("_l"), points.alias("_p"))
    arrays = arrays.select(*keys, "block", "_l", F.col("_p.idx").alias("idx"), F.col("_p.e").alias("e"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block, reach, idx, e in zip(batch["block"], batch["_l"], batch["idx"], batch["e"]):
                dense = np.zeros(size + reach + 1)
                at = np.asarray(idx) - (block * size - reach - 1)
                dense[at] = e
                prefix = dense.cumsum()
                moving = prefix[reach + 1 :] - prefix[: size]
                own = np.asarray(e)[at > reach]
                running = own.cumsum()
                rows.append((len(own), own.sum(), running.sum(), running @ running, moving @ moving / (reach + 1)))
            yield batch[[*keys, "block"]].assign(**dict(zip(("n", "se", "ss", "sss", "vv"), np.array(rows).reshape(-1, 5).T)))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block bigint, n double, se double, ss double, sss double, vv double"
    blocks = arrays.mapInPandas(sums, schema)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.coalesce(F.sum("se").over(before), F.lit(0.0))
    squares = F.col("n") * F.col("_c") * F.col("_c") + 2 * F.col("_c") * F.col("ss") + F.col("sss")
    total = (
        blocks.withColumn("_c", carry)
        .groupBy(*keys)
        .agg(F.sum("n").cast("bigint").alias("n"), F.sum(squares).alias("_top"), F.sum("vv").alias("_vv"))
    )
    return total.select(*keys, "n", F.try_divide(F.col("_top"), F.col("n") * F.col("_vv")).alias("kpss"))


def differencing_order(
    df: DataFrame,
    step: int = 3_600,
    max_d: int = 2,
    lags: int | None = None,
    critical: float = KPSS_CRITICAL_5,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Smallest d whose d-th difference passes the level-stationarity test: ``(area, series, d)`` (M-01).

    All d are tested in one pass. A constant series has no variance and passes.
    """
    rows = indexed(df, step)
    if max_d:
        rows = with_lags(rows, list(range(1, max_d + 1)), size)
    names = []
    for d in range(max_d + 1):
        total: Column = F.col("value")
        for k, c in difference_weights(d, 0, 1).items():
            if k:
                total = total + c * F.col(f"lag_{k}")
        rows = rows.withColumn(f"x{d}", total)
        names.append(F.struct(F.lit(d).alias("d"), F.col(f"x{d}").alias("x")))
    long = rows.select("area", "series", "idx", F.inline(F.array(*names))).where(F.col("x").isNotNull())
    tested = kpss(long, lags, ["area", "series", "d"], size)
    passes = F.coalesce(F.col("kpss") <= critical, F.lit(True))
    return tested.groupBy("area", "series").agg(
        F.coalesce(F.min(F.when(passes, F.col("d"))), F.lit(max_d)).alias("d")
    )
