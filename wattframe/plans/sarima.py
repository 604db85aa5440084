"""Fit, refit or update seasonal lag models and forecast with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import lagmodel, lags, seasonal
from ..operators.lagmodel import SERIES_KEY, Search
from ..session import cut_lineage
from ..sources.results import load_models, save_models

NEW, REFIT, UPDATE = 2, 1, 0


def differencing(df: DataFrame, search: Search, seasonal_critical: float | None = None, kpss_lags: int | None = None) -> DataFrame:
    """``orders(area, series, d, sd)``; by default the truncation grows with a series' length, and the seasonal test has its documented critical value."""
    orders = lags.differencing_order(df, search.step, search.max_d, kpss_lags, size=search.block)
    by_season = lagmodel.seasonal_order(df, search.m, seasonal_critical, search.step, size=search.block)
    joined = orders.join(by_season.select(*SERIES_KEY, "sd"), SERIES_KEY, "left")
    return joined.withColumn("sd", F.least(F.coalesce("sd", F.lit(0)), F.lit(search.max_sd)))


def fit(
    df: DataFrame,
    search: Search = Search(product=True),
    update_level: int = NEW,
    checkpoint: str | None = None,
    save_to: str | None = None,
    seasonal_critical: float | None = None,
) -> DataFrame:
    """All series at once. ``update_level``: 2 = new search, 1 = refit known orders, 0 = add observations.

    The seasonal and the ordinary polynomials are multiplied, unless the search says otherwise (``product=False``).
    A ``checkpoint`` path without a table means a new search. Levels 0 and 1
    need a checkpoint.
    """
    if update_level not in (NEW, REFIT, UPDATE):
        raise ValueError("update_level must be 0, 1 or 2")
    if update_level != NEW and checkpoint is None:
        raise ValueError("update levels 0 and 1 need a checkpoint of models")
    df = cut_lineage(df)  # read by both tests, both stages and the last index
    how = seasonal if search.product else lagmodel
    known = load_models(df.sparkSession, checkpoint) if checkpoint and update_level != NEW else None
    if known is None:
        models = how.fit_new(df, differencing(df, search, seasonal_critical), search)
    elif update_level == REFIT:
        models = how.refit(df, known, search)
    else:
        models = how.update(df, known, search)
    if save_to:
        run_id = save_models(models, save_to)
        models = load_models(df.sparkSession, save_to, run_id)
    return models
