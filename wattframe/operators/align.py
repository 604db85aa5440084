"""Putting readings on common timestamps, and between long and wide layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timegrid import block_of, epoch_second, grid_index, grid_time
from .blocks import BLOCK_ROWS, TIME_BLOCK, join_per_key, keyed, never_null, time_blocks

KEY = ["area", "ts", "series"]
# Seconds of a block of time.
BLOCK_SECONDS = 30 * 86_400


def combine(load: DataFrame, generation: DataFrame) -> DataFrame:
    """Load and generation side by side = a full outer join on the timestamp (J-01).

    In the long layout that is a union followed by :func:`align`.
    """
    return align(load.select(*KEY, "value").unionByName(generation.select(*KEY, "value")))


def align(readings: DataFrame, block_seconds: int | None = None) -> DataFrame:
    """Every series of an area gets a row for every timestamp seen in that area (F-01).

    The readings are shuffled once, by area and block of time; the cells of a
    timestamp are gathered there, and the names of an area come from the same
    exchange, so the source is read once. A timestamp's cells are a map by
    series, bounded by the area's number of series: two readings for one
    (area, ts, series) raise. A row without area, time or series has no cell.

    With ``block_seconds`` the result is shuffled once more, by ``(area,
    series, block of time)``, and the block stays in the result, for
    ``interpolate_time`` to go on from.
    """
    rows = keyed(readings, "area", "series", "ts").select("area", "series", "ts", F.col("value").cast("double").alias("value"))
    block = never_null(block_of(epoch_second("ts"), block_seconds or BLOCK_SECONDS))
    rows = rows.withColumn(TIME_BLOCK, block).repartition("area", TIME_BLOCK)
    cells = F.map_from_entries(F.collect_list(F.struct("series", "value")))
    stamps = rows.groupBy("area", TIME_BLOCK, "ts").agg(cells.alias("_cells"))
    seen = stamps.select("area", F.explode(F.map_keys("_cells")).alias("series")).distinct()
    names = seen.groupBy("area").agg(F.collect_list("series").alias("_names"))
    full = join_per_key(stamps, names, ["area"], F.col("ts"))
    grid = full.select("area", "ts", "_cells", F.explode("_names").alias("series"))
    grid = grid.select(*KEY, F.try_element_at("_cells", F.col("series")).alias("value"))
    return grid if block_seconds is None else time_blocks(grid, block_seconds)


def _spread_bins(spans: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """All bins from ``_lo`` to ``_hi`` of each series.

    First cut into chunks, which go to all tasks, then into bins: a few rows
    can stand for very many bins. The number of partitions is given because the
    adaptive planner would otherwise merge partitions that are still small.
    """
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.explode(F.sequence(block_of(F.col("_lo"), size), block_of(F.col("_hi"), size)))
    first = F.greatest("_lo", F.col("_chunk") * size)
    last = F.least("_hi", (F.col("_chunk") + 1) * size - 1)
    return (
        spans.select("area", "series", "_lo", "_hi", chunk.alias("_chunk"))
        .repartition(tasks, "area", "series", "_chunk")
        .select("area", "series", F.explode(F.sequence(first, last)).alias("_bin"))
    )


def downsample(readings: DataFrame, seconds: int = 3_600) -> DataFrame:
    """Mean per bin of ``seconds``, left-closed, left-labelled, nulls skipped (A-01).

    All bins between the first and the last timestamp of the area are present;
    a bin without data has a null value. Partial aggregation runs before the
    only large shuffle, so a crowded bin is no hot spot. The full grid is made
    from the binned cells, not from a second scan of the readings.
    """
    keys = ["area", "series", "_bin"]
    bin_of = never_null(grid_index("ts", seconds)).alias("_bin")
    binned = keyed(readings, "area", "series", "ts").select("area", "series", bin_of, "value")
    return on_full_grid(binned.groupBy("area", "series", "_bin").agg(F.avg("value").alias("value")), seconds)


def on_full_grid(cells: DataFrame, seconds: int) -> DataFrame:
    """Cells ``(area, series, _bin, value)`` with all bins between the first and the last one of the area."""
    keys = ["area", "series", "_bin"]
    # The count is kept alive by the filter: with the same columns on both
    # sides the exchange of the cells is computed once and reused.
    spans = cells.groupBy("area", "series").agg(
        F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"), F.count("value").alias("_n")
    ).where("_n >= 0")
    bounds = spans.groupBy("area").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    own = spans.select("area", "series", F.col("_lo").alias("_l"), F.col("_hi").alias("_h"))
    spread = join_per_key(own, bounds, ["area"], F.col("series")).where("_l >= _lo AND _h <= _hi")
    spine = _spread_bins(spread)
    return spine.join(cells, keys, "left").select(
        "area", grid_time(F.col("_bin"), seconds).alias("ts"), "series", "value"
    )


def to_wide(df: DataFrame, series: list[str]) -> DataFrame:
    """Long -> one column per listed series; two readings for one cell raise."""
    message = F.concat(F.lit("two readings for one cell at "), F.col("ts").cast("string"))
    one = F.when(F.count("value") <= 1, F.max("value")).otherwise(F.raise_error(F.max(message)).cast("double"))
    return df.groupBy("area", "ts").pivot("series", series).agg(one)


def to_long(df: DataFrame, ids: list[str], series: list[str] | None = None) -> DataFrame:
    """One column per series -> long; nulls are kept."""
    series = [c for c in df.columns if c not in ids] if series is None else series
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in series]
    return df.select(*ids, *values).unpivot(ids, series, "series", "value")
