"""Split in time, cut windows, train, forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import network, windows
from ..session import cut_lineage


def train_forecaster(
    df: DataFrame,
    n_hidden: int = 16,
    training_window: int = 168,
    n_epochs: int = 20,
    step: int = 3_600,
    learning_rate: float = 0.01,
    n_batches: int = 8,
    activation: bool = False,
    seed: int = 0,
    size: int = windows.WINDOW_BLOCK,
):
    """60 / 20 / 20 split, training with early stop: ``(weights, loss history, test blocks, names)``."""
    parts = windows.chronological_split(df, step=step)
    names = windows.feature_names(df)

    def blocks(part: str) -> DataFrame:
        return cut_lineage(
            windows.sequence_blocks(parts.where(F.col("part") == part).drop("part"), training_window, 1, step, size)
        )

    weights = network.initial_weights(len(names), n_hidden, len(names), seed)
    weights, history = network.train(
        blocks("train"), blocks("valid"), weights, training_window, n_epochs, learning_rate,
        n_batches, activation, size=size,
    )
    return weights, history, blocks("test"), names
