"""Sliding training windows over the regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timegrid import block_of, grid_index
from .blocks import join_per_key, with_halo

WINDOW_BLOCK = 1_024


def feature_names(df: DataFrame) -> list[str]:
    """Series names in the order of the feature vector, for a model that has one input for each."""
    return [r.series for r in df.select("series").distinct().orderBy("series").collect()]


def feature_rows(df: DataFrame, step: int) -> DataFrame:
    """``(area, idx, ts, values ARRAY<FLOAT>)``: one vector per timestamp, series in name order (P-15)."""
    cell = F.struct("series", F.col("value").cast("float").alias("value"))
    vector = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["value"])
    return df.groupBy("area", "ts").agg(vector.alias("values")).withColumn("idx", grid_index("ts", step))


def sequence_blocks(
    df: DataFrame, training_window: int, prediction_window: int, step: int, size: int = WINDOW_BLOCK
) -> DataFrame:
    """One row per (area, block) with the rows that the windows starting in the block need.

    A row is copied ``1 + (tw + pw - 1) / size`` times instead of once per
    window. ``first`` and ``last`` are the bounds of the whole area. The grid
    must have no gaps; downsampling makes such a grid.
    """
    rows = feature_rows(df, step)
    bounds = indexed_bounds(df, step)
    whole = F.col("_n") == F.col("last") - F.col("first") + 1
    message = F.lit("the time grid has gaps; downsample before cutting windows")
    first = F.when(whole, F.col("first")).otherwise(F.raise_error(message).cast("bigint"))
    bounded = join_per_key(rows, bounds, ["area"], F.col("idx")).withColumn("first", first).drop("_n")
    halo = with_halo(bounded, "idx", size, ahead=training_window + prediction_window - 1)
    blocks = halo.groupBy("area", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", "ts", "values"))).alias("rows"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min(F.size("values")).alias("_least"),
        F.max(F.size("values")).alias("_most"),
    )
    uneven = F.raise_error(F.lit("a series lacks some timestamps; align before cutting windows")).cast("int")
    width = F.when(F.col("_least") == F.col("_most"), F.col("_most")).otherwise(uneven)
    return blocks.select("area", "block", "rows", "first", "last", width.alias("width"))


def indexed_bounds(df: DataFrame, step: int) -> DataFrame:
    """First and last grid position and number of timestamps per area."""
    positions = df.select("area", grid_index("ts", step).alias("idx")).distinct()
    return positions.groupBy("area").agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("_n")
    )


def window_starts(training_window: int, prediction_window: int, stride: int, size: int):
    """Array expression: grid positions at which the windows of a block start."""
    length = training_window + prediction_window
    low = F.greatest(F.col("block") * size, F.col("first"))
    high = F.least((F.col("block") + 1) * size - 1, F.col("last") - length + 1)
    aligned = low + F.pmod(F.col("first") - low, F.lit(stride).cast("bigint"))
    return F.when(aligned <= high, F.sequence(aligned, F.greatest(aligned, high), F.lit(stride).cast("bigint")))


def windows(
    df: DataFrame,
    training_window: int = 168,
    prediction_window: int = 1,
    stride: int = 1,
    step: int = 3_600,
    size: int = WINDOW_BLOCK,
) -> DataFrame:
    """``(area, window_id, sample, target, target_ts)`` for every ``stride``-th start (W-06).

    ``sample`` is float[tw][F], ``target`` float[pw][F]. Inside a block the
    windows are array slices, so no row is shuffled more than once per block.
    """
    blocks = sequence_blocks(df, training_window, prediction_window, step, size)
    starts = blocks.withColumn("_start", F.explode(window_starts(training_window, prediction_window, stride, size)))
    at = (F.col("_start") - F.col("rows")[0]["idx"]).cast("int")
    starts = starts.where("width > 0")  # keeps the check of the width in the plan
    sample = F.slice("rows", at + 1, F.lit(training_window))
    target = F.slice("rows", at + 1 + training_window, F.lit(prediction_window))
    return starts.select(
        "area",
        block_of(F.col("_start") - F.col("first"), stride).alias("window_id"),
        F.transform(sample, lambda r: r["values"]).alias("sample"),
        F.transform(target, lambda r: r["values"]).alias("target"),
        F.transform(target, lambda r: r["ts"]).alias("target_ts"),
    )


def window_count(
    df: DataFrame, training_window: int = 168, prediction_window: int = 1, stride: int = 1, step: int = 3_600
) -> DataFrame:
    """Number of windows per area without cutting them (W-07, A-10)."""
    spare = F.col("_n") - training_window - prediction_window
    count = F.when(spare >= 0, F.floor(spare / stride) + 1).otherwise(0).cast("bigint")
    return indexed_bounds(df, step).select("area", count.alias("n_windows"))


def window_at(
    df: DataFrame, index: int, training_window: int = 168, prediction_window: int = 1, stride: int = 1, step: int = 3_600
) -> DataFrame:
    """The window number ``index`` of each area, as :func:`windows` gives it (W-07).

    Only the rows of that window leave the scan's tasks; an area with fewer
    windows has none. Gaps and uneven series raise as they do there.
    """
    length = training_window + prediction_window
    bounds = indexed_bounds(df, step).withColumn("_from", F.col("first") + index * stride)
    bounds = bounds.where(F.col("_from") + length - 1 <= F.col("last")).select("area", "_from")
    rows = join_per_key(df.withColumn("_idx", grid_index("ts", step)), bounds, ["area"], F.col("_idx"))
    near = rows.where((F.col("_idx") >= F.col("_from")) & (F.col("_idx") < F.col("_from") + length))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "ts", "values")))
    sizes = [F.min(F.size("values")).alias("_least"), F.max(F.size("values")).alias("_most")]
    one = feature_rows(near.select("area", "ts", "series", "value"), step).groupBy("area").agg(ordered.alias("rows"), *sizes)
    gap = F.raise_error(F.lit("the time grid has gaps; downsample before cutting windows")).cast("boolean")
    uneven = F.raise_error(F.lit("a series lacks some timestamps; align before cutting windows")).cast("boolean")
    whole = F.when(F.size("rows") != length, gap).when(F.col("_least") != F.col("_most"), uneven).otherwise(True)
    sample = F.slice("rows", 1, training_window)
    target = F.slice("rows", training_window + 1, prediction_window)
    return one.where(whole).select(
        "area",
        F.lit(index).cast("bigint").alias("window_id"),
        F.transform(sample, lambda r: r["values"]).alias("sample"),
        F.transform(target, lambda r: r["values"]).alias("target"),
        F.transform(target, lambda r: r["ts"]).alias("target_ts"),
    )


def chronological_split(df: DataFrame, shares: tuple[float, float] = (0.6, 0.2), step: int = 3_600) -> DataFrame:
    """Adds ``part`` = train / valid / test by position in time (D-03)."""
    bounds = indexed_bounds(df, step).select("area", "first", "last")
    rows = df.withColumn("_idx", grid_index("ts", step))
    position = F.col("_idx") - F.col("first")
    length = F.col("last") - F.col("first") + 1
    part = (
        F.when(position < F.floor(length * shares[0]), "train")
        .when(position < F.floor(length * (shares[0] + shares[1])), "valid")
        .otherwise("test")
    )
    joined = join_per_key(rows, bounds, ["area"], F.col("_idx"))
    return joined.withColumn("part", part).drop("_idx", "first", "last")
