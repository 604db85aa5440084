"""What several operators share: words, places in a random order, running totals without one large task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.blocks import join_per_key

#: A word is a run of bytes other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a task sorts at a time, about.
BIN_ROWS = 4_096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) fixed by the columns' values; 15 hex digits of their MD5 digest."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def per_source(rows: DataFrame, small: DataFrame, spread: Column) -> DataFrame:
    """Rows with what ``small`` knows of their ``_group``; the rows of a hot group are salted by ``spread``."""
    return join_per_key(rows, small, ["_group"], spread)


def source_key() -> Column:
    """``source`` as a key that is never null; a null source differs from an empty one."""
    return F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))


def running_total(rows: DataFrame, group: str, place: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, in ``order``.

    ``place`` is a number from 0 below 1 that rises with ``order``; ``_rows`` holds the group's row count. A
    group is cut into bins of about ``BIN_ROWS`` rows by place, the bins' totals are summed up, and rows are
    sorted inside their bin only. So a group with a third of all rows is spread like any other.
    """
    n_bins = F.floor(F.col("_rows") / BIN_ROWS) + 1
    binned = rows.withColumn("_bin", F.least(F.floor(place * n_bins), n_bins - 1)).withColumn("_value", value)
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(group, "_bin").agg(F.sum("_value").alias("_total"))
    starts = totals.select(group, "_bin", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return binned.join(starts, [group, "_bin"]).withColumn(out, total).drop("_bin", "_value", "_start")
