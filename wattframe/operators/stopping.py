"""Loss histories: early stopping and selection of epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def epoch_losses(batch_losses: DataFrame) -> DataFrame:
    """Mean batch loss per (run_id, epoch) (A-09)."""
    return batch_losses.groupBy("run_id", "epoch").agg(F.avg("loss").alias("loss"))


def logged_epochs(losses: DataFrame, interval: int = 10) -> DataFrame:
    """Every ``interval``-th epoch (W-09)."""
    return losses.where(F.col("epoch") % interval == 0)


def early_stop(losses: DataFrame, patience: int = 10, delta: float = 0.0) -> DataFrame:
    """``(run_id, stop_epoch, best_loss)`` of ``losses(run_id, epoch, loss)`` (W-08).

    The first loss is the best so far. A loss above ``best - delta`` adds one to
    the counter, any other becomes the best and resets it. ``stop_epoch`` is
    where the counter reaches ``patience``, null if it never does; ``best_loss``
    is the best one up to there. A run is as long as its number of epochs.
    """
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("waited"),
        F.lit(None).cast("bigint").alias("stop"),
    )

    def step(state, item):
        done = state["stop"].isNotNull()
        worse = state["best"].isNotNull() & (item["loss"] > state["best"] - delta)
        waited = F.when(worse, state["waited"] + 1).otherwise(F.lit(0))
        return F.when(done, state).otherwise(
            F.struct(
                F.when(worse, state["best"]).otherwise(item["loss"]).alias("best"),
                waited.alias("waited"),
                F.when(waited >= patience, item["epoch"]).alias("stop"),
            )
        )

    item = F.struct(F.col("epoch").cast("bigint").alias("epoch"), F.col("loss").cast("double").alias("loss"))
    ordered = losses.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    state = F.aggregate("_l", start, step)
    return ordered.select("run_id", state.alias("_s")).select(
        "run_id", F.col("_s.stop").alias("stop_epoch"), F.col("_s.best").alias("best_loss")
    )
