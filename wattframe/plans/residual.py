"""Readings -> categories -> scaled values -> day-type profiles -> residuals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.timegrid import to_local
from ..operators import align, prepare, profile, scale


@dataclass(frozen=True)
class Preparation:
    """How raw readings become category series."""

    categories: dict[str, list[str]] = field(default_factory=lambda: prepare.CATEGORIES)
    fills: dict[str, float] = field(default_factory=lambda: prepare.CONSTANT_FILL)
    drop_consumption: bool = True
    downsample_seconds: int | None = None
    local_offset_hours: int | None = 1
    block_seconds: int = prepare.BLOCK_SECONDS


def prepared(readings: DataFrame, how: Preparation = Preparation()) -> DataFrame:
    """Align, fill, move to local time, drop, interpolate, regroup, downsample - in this order.

    Interpolation comes before the sums and downsampling after them; another
    order gives other numbers. The drop filter is on a grouping key, so Catalyst
    moves it below the alignment; the timestamps of dropped series still count.
    """
    rows = prepare.as_float(readings)
    if how.local_offset_hours is not None:
        rows = rows.withColumn("ts", to_local("ts", how.local_offset_hours))
    rows = prepare.fill_constant(align.align(rows, how.block_seconds), how.fills)
    if how.drop_consumption:
        rows = prepare.drop_matching(rows)
    rows = prepare.map_categories(prepare.interpolate_time(rows), how.categories, how.block_seconds)
    return align.downsample(rows, how.downsample_seconds) if how.downsample_seconds else rows


def residual_dataset(
    rows: DataFrame,
    lookback: int = 3,
    step: int = 3_600,
    country: str = "DE",
    holidays: DataFrame | None = None,
    on_partial: str = "error",
    scaler: DataFrame | None = None,
) -> DataFrame:
    """Prepared rows with profile and residual, raw and scaled.

    The profile is a mean of values, so the profile of the scaled values is the
    scaled profile: one window pass serves both.
    """
    scaler = scale.fit_scaler(rows) if scaler is None else scaler
    profiled = profile.residuals(profile.profiles(rows, lookback, step, country, holidays, on_partial))
    rows = scale.with_scale(profiled, scaler)
    return rows.withColumns({
        "scaled": (F.col("value") - F.col("_low")) / F.col("_width"),
        "scaled_pslp": (F.col("pslp") - F.col("_low")) / F.col("_width"),
        "scaled_residual": F.col("residual") / F.col("_width"),
    }).drop("_low", "_width")
