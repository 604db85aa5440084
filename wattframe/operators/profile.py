"""Day-type profiles: the mean of the last k days of the same day type."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.daytype import day_type, next_same_type
from ..functions.timegrid import DAY_SECONDS, grid_time, slot_of_day
from ..session import cut_lineage

PARTIAL_MODES = ("error", "skip", "null")


def _date(df: DataFrame) -> Column:
    """The rows' date; a column ``date``, as ``readings.read_days`` keeps it, is the date of ``ts`` already."""
    return F.col("date") if "date" in df.columns else F.to_date("ts").alias("date")


def _kind(holidays: DataFrame | None, country: str) -> Column:
    flag = None if holidays is None else F.col("_holiday")
    return day_type(F.col("date"), flag, country)


def _day_rows(df: DataFrame) -> DataFrame:
    """Least and most rows that a series of the area has on a date."""
    rows = df.groupBy("area", "series", _date(df)).agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("area", "date").agg(F.min("_n").alias("least_rows"), F.max("_n").alias("most_rows"))


def _with_holidays(days: DataFrame, holidays: DataFrame | None, country: str) -> DataFrame:
    if holidays is None:
        return days
    listed = holidays.where(F.col("country") == country).select("date", F.lit(True).alias("_holiday")).distinct()
    return days.join(listed, "date", "left")


def day_table(df: DataFrame, step: int, country: str = "DE", holidays: DataFrame | None = None) -> DataFrame:
    """One row per (area, date): day type, rows of its series, full-day flag (A-06, P-09, W-05).

    A day is full if every series has as many rows as a day has steps, neither
    fewer nor more: a repeated hour, or a ``step`` that is not that of the data,
    makes days that are not full.
    """
    days = _with_holidays(_day_rows(df), holidays, country)
    usual = DAY_SECONDS // step
    return days.select(
        "area",
        "date",
        _kind(holidays, country).alias("day_type"),
        "least_rows",
        "most_rows",
        ((F.col("least_rows") == usual) & (F.col("most_rows") == usual)).alias("full"),
    )


def rank_days(days: DataFrame, skip_partial: bool = False) -> DataFrame:
    """Adds ``day_rank``: how many usable days of the same day type come before (W-03).

    Days are counted as they occur in the data, not on the calendar.
    """
    before = Window.partitionBy("area", "day_type").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col("full").cast("int") if skip_partial else F.lit(1)
    return days.withColumn("day_rank", F.coalesce(F.sum(usable).over(before), F.lit(0)).cast("int"))


def last_days(days: DataFrame, k: int) -> DataFrame:
    """The last ``k`` dates of each (area, day type), newest first (W-03)."""
    newest = Window.partitionBy("area", "day_type").orderBy(F.desc("date"))
    return days.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= k)


def partial_days(df: DataFrame, usual_length: int = 96) -> DataFrame:
    """Dates on which a series has fewer or more rows than ``usual_length``, as time shifts leave them (A-05, W-05)."""
    usual = (F.col("least_rows") == usual_length) & (F.col("most_rows") == usual_length)
    return _day_rows(df).where(~usual).select("area", "date", "least_rows", "most_rows")


def _check_mode(on_partial: str) -> None:
    if on_partial not in PARTIAL_MODES:
        raise ValueError(f"on_partial must be one of {PARTIAL_MODES}")


def _partial_error(date: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not a full day in the time series data: "), date.cast("string")))


def profiles(
    df: DataFrame,
    lookback: int = 3,
    step: int = 3_600,
    country: str = "DE",
    holidays: DataFrame | None = None,
    on_partial: str = "error",
) -> DataFrame:
    """Profile of every row: ``(area, ts, series, value, day_type, pslp)`` (W-01, A-08).

    ``pslp`` is the mean, slot by slot, over the last ``lookback`` earlier dates
    of the same day type in the data; null with fewer dates or a null slot.
    ``on_partial`` says what a lookback day without all its slots does: raise,
    be passed over, or make the profile null.

    The value shuffle is keyed by (area, series, day type, slot), which spreads
    even one long series over 3 x slots-per-day tasks. The frame is a range
    over the rank of the day, so a missing slot never moves the lookback to an
    older day.
    """
    _check_mode(on_partial)
    days = rank_days(day_table(df, step, country, holidays), skip_partial=on_partial == "skip")
    rows = df.select(
        "area", "ts", "series", "value", _date(df), slot_of_day("ts", step).alias("slot")
    ).join(days.select("area", "date", "day_type", "day_rank", "full"), ["area", "date"])
    back = (
        Window.partitionBy("area", "series", "day_type", "slot").orderBy("day_rank").rangeBetween(-lookback, -1)
    )
    usable = F.when(F.col("full"), F.col("value")) if on_partial != "error" else F.col("value")
    mean = F.when(F.count(usable).over(back) == lookback, F.avg(usable).over(back))
    if on_partial == "error":
        bad_day = F.max(F.when(~F.col("full"), F.col("date"))).over(back)
        enough = F.col("day_rank") >= lookback
        mean = F.when(enough & bad_day.isNotNull(), _partial_error(bad_day).cast("double")).otherwise(mean)
    return rows.select("area", "ts", "series", "value", "day_type", mean.alias("pslp"))


def _mean_of(df: DataFrame, chosen: DataFrame, lookback: int, step: int, on_partial: str) -> DataFrame:
    """Slot means over the rows of the chosen (area, date, target_date) days.

    Where the rows have a folder for each date, the chosen days are settled first, from counts, as a written table:
    Spark then knows its size and reads only the folders of its dates.
    """
    if "date" in df.columns:
        chosen = cut_lineage(chosen).where(F.col("date") < F.col("target_date"))  # true of all; lets Spark prune by them
    rows = (
        df.select("area", "series", "value", _date(df), slot_of_day("ts", step).alias("slot"))
        .join(chosen, ["area", "date"])
    )
    if on_partial == "error":
        rows = rows.withColumn(
            "value", F.when(~F.col("full"), _partial_error(F.col("date")).cast("double")).otherwise(F.col("value"))
        )
    elif on_partial == "null":
        rows = rows.withColumn("value", F.when(F.col("full"), F.col("value")))
    means = rows.groupBy("area", "series", "target_date", "day_type", "slot").agg(
        F.when(F.count("value") == lookback, F.avg("value")).alias("pslp")
    )
    midnight = F.unix_date("target_date").cast("bigint") * (DAY_SECONDS // step)
    return means.select(
        "area", grid_time(midnight + F.col("slot"), step).alias("ts"), "series", "day_type", "pslp"
    )


def future_profiles(
    df: DataFrame,
    lookback: int = 3,
    step: int = 3_600,
    country: str = "DE",
    holidays: DataFrame | None = None,
    on_partial: str = "error",
    strict: bool = False,
) -> DataFrame:
    """One profile per day type, for its first date in the 7 days after the data (W-02).

    ``strict`` raises where a day type has fewer than ``lookback`` days;
    otherwise it is left out.
    """
    _check_mode(on_partial)
    days = day_table(df, step, country, holidays)
    return _future_means(df, days, _future_targets(days, country, holidays), lookback, step, on_partial, strict)


def _future_targets(days: DataFrame, country: str, holidays: DataFrame | None) -> DataFrame:
    """First date of each day type in the week after the data."""
    ends = days.groupBy("area").agg(F.max("date").alias("data_end"))
    week = ends.select(
        "area", F.explode(F.sequence(F.date_add("data_end", 1), F.date_add("data_end", 7))).alias("date")
    )
    return (
        _with_holidays(week, holidays, country).select("area", "date", _kind(holidays, country).alias("day_type"))
        .groupBy("area", "day_type")
        .agg(F.min("date").alias("target_date"))
    )


def _future_means(
    df: DataFrame, days: DataFrame, targets: DataFrame, lookback: int, step: int, on_partial: str, strict: bool
) -> DataFrame:
    usable = days.where("full") if on_partial == "skip" else days
    chosen = last_days(usable, lookback).join(targets, ["area", "day_type"])
    chosen = chosen.withColumn("_n", F.count("*").over(Window.partitionBy("area", "day_type")))
    if strict:
        message = F.concat(F.lit(f"fewer than {lookback} days of day type "), F.col("day_type").cast("string"))
        short = F.when(F.col("_n") < lookback, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        chosen = chosen.where(short)
    else:
        chosen = chosen.where(F.col("_n") == lookback)
    return _mean_of(df, chosen.select("area", "date", "target_date", "day_type", "full"), lookback, step, on_partial)


def profile_for_date(
    df: DataFrame,
    date: str,
    lookback: int = 3,
    step: int = 3_600,
    country: str = "DE",
    holidays: DataFrame | None = None,
    on_partial: str = "error",
    on_missing: str = "error",
) -> DataFrame:
    """Profile of one date ``YYYYMMDD``, in the data or just after it: ``(area, ts, series, day_type, pslp, status)`` (W-02).

    Every area is judged by its own dates, in the plan: no job runs before the
    result. Where the date lies before an area's data or too far after it, or
    fewer than ``lookback`` days of its type come before, ``on_missing`` says
    whether that raises (``"error"``) or the area gets a single row with the
    reason in ``status`` and nulls (``"status"``). ``status`` is ``"ok"`` otherwise.
    """
    _check_mode(on_partial)
    if on_missing not in ("error", "status"):
        raise ValueError("on_missing must be 'error' or 'status'")
    day = F.lit(dt.datetime.strptime(date, "%Y%m%d").date())
    days = day_table(df, step, country, holidays)
    ends = days.groupBy("area").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    asked = _with_holidays(ends.withColumn("date", day), holidays, country)
    asked = asked.select("area", "_first", "_last", day.alias("target_date"), _kind(holidays, country).alias("day_type"))
    ahead = _future_targets(days, country, holidays).where(F.col("target_date") == day).select("area", F.lit(True).alias("_ahead"))
    earlier = (days.where("full") if on_partial == "skip" else days).where(F.col("date") < day)
    chosen = last_days(earlier, lookback).join(asked.select("area", "day_type", "target_date"), ["area", "day_type"])
    counts = chosen.groupBy("area").agg(F.count(F.lit(1)).alias("_n"))
    reason = (
        F.when(day < F.col("_first"), f"{date} lies before the data")
        .when((day > F.col("_last")) & F.col("_ahead").isNull(), f"{date} lies too far after the data")
        .when(F.coalesce("_n", F.lit(0)) < lookback, f"fewer than {lookback} days of the same day type before {date}")
        .otherwise("ok")
    )
    judged = asked.join(ahead, "area", "left").join(counts, "area", "left").select("area", reason.alias("status"))
    if on_missing == "error":
        message = F.concat(F.lit("no profile of "), F.col("area"), F.lit(": "), F.col("status"))
        judged = judged.withColumn("status", F.when(F.col("status") == "ok", "ok").otherwise(F.raise_error(message).cast("string")))
    usable = chosen.join(judged.where("status = 'ok'"), "area", "left_semi")
    means = _mean_of(df, usable.select("area", "date", "target_date", "day_type", "full"), lookback, step, on_partial)
    return judged.join(means, "area", "left").select("area", "ts", "series", "day_type", "pslp", "status")


def residuals(profiled: DataFrame) -> DataFrame:
    """Actual minus profile; the row already holds both, so no join is needed (P-11)."""
    return profiled.withColumn("residual", F.col("value") - F.col("pslp"))


def attach_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Put a profile table beside the rows of the same timestamp and series (J-03)."""
    return df.join(profile.select("area", "ts", "series", "pslp"), ["area", "ts", "series"], "left")
