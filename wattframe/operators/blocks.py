"""Splitting long series into blocks.

A window over ``(area, series)`` puts one long series into one task. The
operators of this package key their shuffles by ``(area, series, block)``
instead, where a block is a run of consecutive grid positions, and carry what
crosses a block border in one of two ways:

* ``with_halo``: a row is also sent to the neighbouring blocks that look at it.
  Copies per row: about ``1 + (back + ahead) / size``.
* a per-block summary, scanned over the few blocks of each series, joined back
  on the block key (see ``prepare.interpolate_time`` and ``lags.kpss``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timegrid import block_of, epoch_second

BLOCK_ROWS = 4_096
TIME_BLOCK = "_block"


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with complete keys.

    A join asks for the same filter on its inputs. Stating it first gives every
    use of ``df`` the same plan, so that Spark can reuse its exchange.
    """
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return df.where(complete)


def never_null(key: Column) -> Column:
    """A key computed from a column that is known to be there.

    Stated for the planner: it then does not ask for a null filter on the
    computed key, which would repeat the computation for every row of the scan.
    """
    return F.coalesce(key, F.lit(0).cast("bigint"))


def time_blocks(df: DataFrame, seconds: int) -> DataFrame:
    """``(area, series, ts, value)`` shuffled by series and block of ``seconds``."""
    block = never_null(block_of(epoch_second("ts"), seconds)).alias(TIME_BLOCK)
    rows = keyed(df, "area", "series").select("area", "series", "ts", "value", block)
    return rows.repartition("area", "series", TIME_BLOCK)


def with_halo(df: DataFrame, index: str, size: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Send each row to every block that needs it.

    ``back`` is how many positions a block looks back, ``ahead`` how many it
    looks ahead. Adds ``block`` and ``core`` (true in the row's own block).
    """
    own = never_null(block_of(F.col(index), size))
    first = never_null(block_of(F.col(index) - ahead, size))
    last = never_null(block_of(F.col(index) + back, size))
    return (
        df.withColumn("_own", own)
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("core", F.col("block") == F.col("_own"))
        .drop("_own")
    )


def join_per_key(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int | None = None) -> DataFrame:
    """Inner equi-join of many rows per key with one row per key.

    No broadcast hint: the adaptive planner broadcasts ``small`` when its
    measured size allows. For the other case both sides are salted, so a key
    that holds a third of all rows is still spread over ``salts`` tasks, by
    default as many as a shuffle has.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.coalesce(F.pmod(F.hash(spread), F.lit(salts)), F.lit(0))  # never null, see never_null
    return rows.withColumn("_salt", salt).join(salted, [*keys, "_salt"]).drop("_salt")


def sum_arrays(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Element-wise sum of equally long arrays per key.

    The arrays are taken apart into ``(key, position, value)``: tasks add what they have before the shuffle, and
    no task holds the arrays of all others. Only the sums of a key are put together again.
    """
    cells = df.select(*keys, F.posexplode(column).alias("_pos", "_x"))
    sums = cells.groupBy(*keys, "_pos").agg(F.sum("_x").alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_x")))
    total = sums.groupBy(*keys).agg(ordered.alias("_all"))
    return total.select(*keys, F.when(F.size("_all") > 0, F.transform("_all", lambda c: c["_x"])).alias(column))
