"""Column expressions for local time, the arithmetic row index and slots.

``ts`` is a ``TIMESTAMP_NTZ`` in local standard time once :func:`to_local` has
run. None of the expressions below depends on the session time zone for such a
column, and none needs a shuffle: the index of a row on a regular grid is
arithmetic, not a ``row_number()`` over the whole series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DAY_SECONDS = 86_400


def _div(a: Column, b: int) -> Column:
    """Integer floor division, also right for negative numbers."""
    divisor = F.lit(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, divisor), divisor)


def interval(seconds: int) -> Column:
    """A day-time interval literal."""
    return F.lit(dt.timedelta(seconds=seconds))


def _after_origin(unit: dt.timedelta, count: Column) -> Column:
    """1970-01-01 plus ``count`` units: one exact multiplication of an interval."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.lit(unit) * count


def to_local(ts: Column | str, offset_hours: int = 1) -> Column:
    """Instant -> ``TIMESTAMP_NTZ`` at a fixed offset from UTC, without DST (P-04)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return _after_origin(dt.timedelta(microseconds=1), F.unix_micros(ts)) + interval(offset_hours * 3_600)


def zone_bound(day: str, zone: str) -> Column:
    """Midnight of ``YYYYMMDD`` in ``zone`` as an instant."""
    midnight = F.lit(dt.datetime.strptime(day, "%Y%m%d").isoformat(sep=" ")).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.current_timezone(), midnight).cast("timestamp")


def parse_day(text: Column | str) -> Column:
    """``YYYYMMDD`` -> ``DATE`` (P-14)."""
    return F.to_date(text, "yyyyMMdd")


def format_day(date: Column | str) -> Column:
    """``DATE`` -> ``YYYY-mm-dd`` (P-14)."""
    return F.date_format(date, "yyyy-MM-dd")


def time_range(start: Column, end: Column, step: int) -> Column:
    """Array of timestamps from ``start`` to ``end``, both included (G-01)."""
    return F.sequence(start, end, interval(step))


def day_slots(date: Column, step: int) -> Column:
    """Array of the slots of a day from its midnight (G-02)."""
    midnight = date.cast("timestamp_ntz")
    return F.sequence(midnight, midnight + interval(DAY_SECONDS - step), interval(step))


def second_of_day(ts: Column | str) -> Column:
    """Whole seconds since midnight."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_second(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 on the column's own clock (``BIGINT``)."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * DAY_SECONDS + second_of_day(ts)


def epoch_exact(ts: Column | str) -> Column:
    """Seconds since 1970-01-01 with the fraction (``DOUBLE``)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(F.to_date(ts)).cast("double") * DAY_SECONDS
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.date_part(F.lit("SECOND"), ts).cast("double")
    )


def grid_index(ts: Column | str, step: int) -> Column:
    """Position on the regular grid of ``step`` seconds, counted from 1970-01-01."""
    return _div(epoch_second(ts), step)


def grid_time(index: Column, step: int) -> Column:
    """Inverse of :func:`grid_index` as ``TIMESTAMP_NTZ``."""
    return _after_origin(dt.timedelta(seconds=step), index.cast("bigint"))


def slot_of_day(ts: Column | str, step: int) -> Column:
    """0-based position inside the day for a grid of ``step`` seconds (W-04)."""
    return F.call_function("div", second_of_day(ts), F.lit(step)).cast("int")


def block_of(index: Column, size: int) -> Column:
    """Number of the block of ``size`` consecutive grid positions."""
    return _div(index.cast("bigint"), size)
