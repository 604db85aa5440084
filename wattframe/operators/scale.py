"""One global min-max scale for all series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fit_scaler(df: DataFrame) -> DataFrame:
    """``scaler(min, max)`` over all cells of all series, nulls ignored (A-02)."""
    return df.agg(F.min("value").alias("min"), F.max("value").alias("max"))


def with_scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Adds ``_low`` and ``_width`` of the scaler, one subquery for both; a constant table has the width 1."""
    both = scaler.select(F.struct(F.col("min").alias("low"), F.when(F.col("max") == F.col("min"), F.lit(1.0))
                                  .otherwise(F.col("max") - F.col("min")).alias("width")).alias("bounds"))
    rows = df.withColumn("_bounds", both.scalar())
    return rows.withColumns({"_low": F.col("_bounds.low"), "_width": F.col("_bounds.width")}).drop("_bounds")


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """``(x - min) / (max - min)``; a constant table becomes 0, nulls stay (A-03)."""
    rows = with_scale(df, scaler)
    return rows.withColumn("value", (F.col("value") - F.col("_low")) / F.col("_width")).drop("_low", "_width")


def unscale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Inverse of :func:`scale` (A-04)."""
    rows = with_scale(df, scaler)
    return rows.withColumn("value", F.col("value") * F.col("_width") + F.col("_low")).drop("_low", "_width")
