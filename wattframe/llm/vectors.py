"""Vectors as rows and as blocks of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def usable(vector: Column) -> Column:
    """Neither null nor with a null or a component that is no finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def one_per_id(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` (doubles) of the usable rows. Of rows that share an id the greatest vector stands for all."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.max("vector").alias("vector"))


def first_of_equals(rows: DataFrame, n: int) -> DataFrame:
    """Of rows with equal vectors those with the ``n`` smallest ids.

    Equal vectors have equal scores, and ties go to smaller ids, so a search for ``n - 1`` results besides the
    query's own row never needs more. Each task cuts its rows before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids, best first."""
    return np.lexsort((ids, -scores))[:k]


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
