"""Downsampling of readings that keep arriving (A-01 on a stream).

Means per bin are kept as state by event time. Every micro-batch writes the bins that it changed, as they are now, into a
folder of its own, which a replay of the batch overwrites; a reader takes the last writing of each bin. So the result
after the last batch is that of :func:`operators.align.downsample` on all rows that were not too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.timegrid import epoch_second
from ..operators.align import on_full_grid

BIN_KEY = ["area", "series", "_bin"]
BIN_SCHEMA = "area string, series string, _bin bigint, total double, n bigint, batch bigint"


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None, names: str = "*.parquet") -> DataFrame:
    """Parquet files that land in ``folder`` under such ``names``, the oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def bin_sums(readings: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Sum and number of values per bin of a stream: ``(area, series, _bin, total, n)``.

    Bins are left-closed; a null value makes a bin, but does not count. A row whose bin ended ``lateness`` or more
    before the latest timestamp that was known a batch ago is left out; the state of such bins is dropped. A row
    without area, series or time is left out.
    """
    rows = readings.where("area IS NOT NULL AND series IS NOT NULL AND ts IS NOT NULL").select(
        "area", "series", F.timestamp_seconds(epoch_second("ts")).alias("_time"), F.col("value").cast("double").alias("value"))
    bins = rows.withWatermark("_time", lateness).groupBy("area", "series", F.window("_time", f"{seconds} seconds").alias("_w")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n"))
    start = F.expr(f"unix_seconds(_w.start) div {seconds}")
    return bins.select("area", "series", start.alias("_bin"), "total", "n")


def start(readings: DataFrame, out: str, checkpoint: str, seconds: int = 3_600, lateness: str = "1 day", once: bool = True) -> StreamingQuery:
    """Run the stream into ``out``: until all that has landed is read (``once``), or on and on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch_{number:012d}")

    writer = bin_sums(readings, seconds, lateness).writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def downsampled(spark: SparkSession, out: str, seconds: int = 3_600) -> DataFrame:
    """``(area, ts, series, value)`` of what the stream wrote so far, on the full grid of each area."""
    rows = spark.read.schema(BIN_SCHEMA).parquet(f"{out}/batch_*")
    last = rows.groupBy(*BIN_KEY).agg(F.max_by(F.struct("total", "n"), "batch").alias("_last"))
    mean = F.try_divide(F.col("_last.total"), F.col("_last.n"))
    return on_full_grid(last.select(*BIN_KEY, mean.alias("value")), seconds)
