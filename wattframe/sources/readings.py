"""Reading load and generation data that has been landed as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timegrid import zone_bound
from ..operators.align import to_long

# Default area and zone of the query bounds.
GERMANY = "10Y1001A1001A83F"
ZONE = "Europe/Berlin"
READINGS_SCHEMA = "area string, ts timestamp, series string, value double"


def read_readings(
    spark: SparkSession, path: str, start: str, end: str, area: str = GERMANY, zone: str = ZONE
) -> DataFrame:
    """Readings of one area from midnight ``start`` to before midnight ``end`` (S-01).

    Dates are ``YYYYMMDD`` in ``zone``. Area and bounds are plain comparisons
    with constants, so they reach the parquet scan; in the layout of
    :func:`write_readings` only folders near the range are listed.
    """
    readings = spark.read.schema(READINGS_SCHEMA).parquet(path)
    if "date" in readings.columns:
        # One day of slack: the folder's date depends on the writer's zone.
        near = F.date_sub(F.to_date(zone_bound(start, zone)), 1), F.date_add(F.to_date(zone_bound(end, zone)), 1)
        readings = readings.where(F.col("date").between(*near)).drop("date")
    return select_range(readings, start, end, area, zone)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """All readings in the layout of :func:`write_readings`, with the ``date`` of each: ``(area, ts, series, value, date)``.

    Profiles of one date or of the days to come count the days by their folders and read only those they need.
    """
    return spark.read.schema(READINGS_SCHEMA + ", date date").parquet(path)


def select_range(readings: DataFrame, start: str, end: str, area: str = GERMANY, zone: str = ZONE) -> DataFrame:
    """The rows of ``area`` with ``start <= ts < end``."""
    ts = F.col("ts")
    return readings.where(
        (F.col("area") == area) & (ts >= zone_bound(start, zone)) & (ts < zone_bound(end, zone))
    )


def write_readings(readings: DataFrame, path: str) -> None:
    """Land readings partitioned by area and date, the layout that S-01 prunes.

    The rebalance hint splits a folder that holds much more than the others.
    """
    dated = readings.withColumn("date", F.to_date("ts"))
    dated.hint("rebalance", F.col("area"), F.col("date")).write.mode("append").partitionBy("area", "date").parquet(path)


def platform_name(column: str) -> str:
    """``Biomass  - Actual Aggregated [MW]`` -> ``Biomass Actual Aggregated``."""
    words = column.replace("[MW]", " ").replace(" - ", " ").split()
    return " ".join(words)


def platform_start(mtu: Column, pattern: str = "dd.MM.yyyy HH:mm") -> Column:
    """Start of an ``<start> - <end>`` time unit as ``TIMESTAMP_NTZ``."""
    return F.to_timestamp_ntz(F.trim(F.split_part(mtu, F.lit(" - "), F.lit(1))), F.lit(pattern))


def _named(raw: DataFrame, pattern: str) -> DataFrame:
    """Area, start of the time unit, and one double per type under its plain name."""
    area, mtu, *types = raw.columns
    return raw.select(
        F.col(f"`{area}`").alias("area"),
        platform_start(F.col(f"`{mtu}`"), pattern).alias("ts"),
        *[F.expr(f"try_cast(`{c}` as double)").alias(platform_name(c)) for c in types],
    )


def platform_readings(raw: DataFrame, pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """Area, time unit and one text column per type -> long readings (S-02).

    Values that are no number (such as ``n/e``) become null. ``ts`` is the
    start of the unit on the file's own clock.
    """
    return to_long(_named(raw, pattern), ["area", "ts"])


def read_platform_csv(spark: SparkSession, path: str | list[str], pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """The platform's CSV files as long readings (S-02).

    Columns go by name: files are grouped by their header line, each group is
    read by its own header, and a type that a group lacks is null there. Area
    and time unit are the first two columns of every file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"))
    headers = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in headers.orderBy("file").collect():  # one row per file
        groups.setdefault(row.header, []).append(row.file)
    if not groups:
        raise ValueError(f"no CSV files in {path}")
    first, *others = (_named(spark.read.csv(files, header=True), pattern) for files in groups.values())
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return to_long(first, ["area", "ts"])
