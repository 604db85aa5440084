"""Writing results, models and weights as tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def run_name(name: str, now: dt.datetime | None = None) -> str:
    """``YYYY-mm-dd--HH-MM-SS-<name>-<8 hex digits>``."""
    now = now or dt.datetime.now()
    return f"{now:%Y-%m-%d--%H-%M-%S}-{name}-{uuid.uuid4().hex[:8]}"


def write_results(df: DataFrame, path: str, name: str = "", experiment_id: str = "default") -> str:
    """Append to ``path/run_date=/experiment_id=/`` and return the ``run_id`` written with each row (S-03)."""
    now = dt.datetime.now()
    run_id = run_name(name, now)
    tagged = (
        df.withColumn("run_id", F.lit(run_id))
        .withColumn("run_date", F.lit(now.date()))
        .withColumn("experiment_id", F.lit(experiment_id))
    )
    tagged.write.mode("append").partitionBy("run_date", "experiment_id").parquet(path)
    return run_id


def save_models(models: DataFrame, path: str, name: str = "models") -> str:
    """Append one row per model to the models table and return its ``run_id`` (S-04).

    Runs are folders of their own; ``created_at`` has microseconds, so the
    latest of two runs within a second is known.
    """
    now = dt.datetime.now(dt.timezone.utc)
    run_id = run_name(name)
    tagged = models.withColumn("created_at", F.lit(now)).withColumn("run_id", F.lit(run_id))
    tagged.write.mode("append").partitionBy("run_id").parquet(path)
    return run_id


def load_models(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame | None:
    """Models of one run, the latest by default; None where the table is missing (S-04)."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if run_id is None:
        run_id = table.agg(F.max_by("run_id", "created_at")).first()[0]
    return table.where(F.col("run_id") == run_id).drop("run_id", "created_at")


def save_weights(weights: DataFrame, path: str) -> None:
    """Append a weights table (S-05)."""
    weights.write.mode("append").parquet(path)
