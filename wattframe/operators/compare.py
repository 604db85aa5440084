"""Actual against predicted: residuals, errors, the table behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import display_label

KEY = ["area", "ts", "series"]
# Smallest divisor of the percentage error, unit of the plots.
EPSILON = 2.220446049250313e-16
UNIT = "Mega Watt"


def aligned_difference(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Full outer subtraction on (area, ts, series); null where either side is (J-02, P-11)."""
    left = actual.select(*KEY, F.col("value").alias("actual"))
    right = predicted.select(*KEY, F.col("value").alias("predicted"))
    both = left.join(right, KEY, "full")
    return both.withColumn("residual", F.col("actual") - F.col("predicted"))


def paired(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Actual and predicted by key, only where both have a row (J-06)."""
    left = actual.select(*KEY, F.col("value").alias("actual"))
    right = predicted.select(*KEY, F.col("value").alias("predicted"))
    return left.join(right, KEY)


def error_metrics(pairs: DataFrame, on_null: str = "error", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """``errors(series, mae, mape, mse, n)`` from (actual, predicted) pairs (A-07)."""
    if on_null not in ("error", "drop"):
        raise ValueError("on_null must be 'error' or 'drop'")
    error = F.col("actual") - F.col("predicted")
    if on_null == "drop":
        pairs = pairs.where(error.isNotNull())
    else:
        message = F.lit("null in actual or predicted; use on_null='drop' to leave such rows out")
        error = F.when(error.isNull(), F.raise_error(message).cast("double")).otherwise(error)
    size = F.abs(error)
    return (
        pairs.select(*by, "actual", error.alias("_e"), size.alias("_a"))
        .groupBy(*by)
        .agg(
            F.avg("_a").alias("mae"),
            F.avg(F.col("_a") / F.greatest(F.abs("actual"), F.lit(EPSILON))).alias("mape"),
            F.avg(F.col("_e") * F.col("_e")).alias("mse"),
            F.count("*").alias("n"),
        )
    )


def comparison_table(differences: DataFrame) -> DataFrame:
    """Long ``(area, ts, series, label, kind, value, unit)`` rows behind the plots (P-13)."""
    labelled = differences.select(
        "area",
        "ts",
        "series",
        display_label("series").alias("_name"),
        "actual",
        "predicted",
        F.col("residual").alias("residuals"),
    )
    long = labelled.unpivot(
        ["area", "ts", "series", "_name"], ["actual", "predicted", "residuals"], "kind", "value"
    )
    label = F.when(F.col("kind") == "actual", F.col("_name")).otherwise(F.concat_ws(" ", "_name", "kind"))
    return long.select("area", "ts", "series", label.alias("label"), "kind", "value", F.lit(UNIT).alias("unit"))


def series_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Series of ``left`` that ``right`` lacks (U-01)."""
    return left.select("series").distinct().subtract(right.select("series").distinct())


def series_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Series that both tables have (U-01)."""
    return left.select("series").intersect(right.select("series"))


def summary(df: DataFrame) -> DataFrame:
    """Rows, timestamps and series per area (A-10)."""
    return df.groupBy("area").agg(
        F.count("*").alias("n_cells"),
        F.countDistinct("ts").alias("n_rows"),
        F.countDistinct("series").alias("n_series"),
    )


def supply_balance(df: DataFrame, load: str = "actual_load") -> DataFrame:
    """Generation total minus load per timestamp (D-06)."""
    is_load = F.col("series") == load
    generation = F.sum(F.when(~is_load, F.col("value")))
    demand = F.sum(F.when(is_load, F.col("value")))
    return df.groupBy("area", "ts").agg(
        generation.alias("generation"), demand.alias("load"), (generation - demand).alias("balance")
    )
