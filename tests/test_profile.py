import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions import daytype, labels, timegrid
from wattframe.operators import profile
from wattframe.plans import residual


def kinds(spark, *days):
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")
    got = df.select("date", daytype.day_type(F.col("date")).alias("k")).collect()
    found = {str(r.date): r.k for r in got}
    return [found[d] for d in days]


def test_day_types(spark):
    days = ["2017-12-24", "2018-12-24", "2022-12-31", "2020-10-03", "2024-01-01", "2024-01-05"]
    assert kinds(spark, *days) == [2, 1, 1, 2, 2, 0]


def test_holidays_2024(spark):
    got = [str(r.date)[5:] for r in daytype.holiday_table(spark, 2024, 2024).orderBy("date").collect()]
    assert got == ["01-01", "03-29", "04-01", "05-01", "05-09", "05-20", "10-03", "12-25", "12-26"]


def test_single_holiday_and_table_agree_with_the_rule(spark):
    days = spark.sql("select explode(sequence(date'1995-01-01', date'2035-12-31')) date")
    table = daytype.holiday_table(spark, 1995, 2035)
    rule = days.where(daytype.is_holiday(F.col("date"))).select("date")
    assert rule.exceptAll(table.select("date").distinct()).isEmpty()
    assert table.select("date").distinct().exceptAll(rule).isEmpty()
    assert not rule.where("date = date'2017-10-31'").isEmpty() and rule.where("date = date'2018-10-31'").isEmpty()


def test_easter(spark):
    want = {1818: "1818-03-22", 1943: "1943-04-25", 1954: "1954-04-18", 1981: "1981-04-19", 2000: "2000-04-23",
            2024: "2024-03-31", 2025: "2025-04-20", 2049: "2049-04-18"}
    df = spark.createDataFrame([(y,) for y in want], "y int").select("y", daytype.easter_sunday(F.col("y")).alias("e"))
    assert {r.y: str(r.e) for r in df.collect()} == want


def test_own_holiday_table(spark, readings):
    df = readings([1.0] * 24 * 3, start="2024-01-03 00:00:00")
    table = spark.createDataFrame([("XX", dt.date(2024, 1, 4), "Own")], "country string, date date, name string")
    got = profile.day_table(df, 3600, "XX", table).orderBy("date").collect()
    assert [r.day_type for r in got] == [0, 2, 0]
    with pytest.raises(ValueError):
        daytype.is_holiday(F.col("date"), "XX")


def test_next_same_type(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),)], "d date")
    got = df.select("d", daytype.next_same_type(F.col("d")).alias("n")).orderBy("d").collect()
    assert [str(r.n) for r in got] == ["2024-01-08", "2024-01-13"]
    none = df.select(daytype.next_same_type(F.col("d"), F.lit(7)).alias("n")).first()
    assert none.n is None


def test_time_grid(spark):
    df = spark.sql("select explode(sequence(timestamp_ntz'1969-12-30 05:00:00', timestamp_ntz'1970-01-03 00:00:00', "
                   "interval 7 hours)) ts")
    back = df.withColumn("back", timegrid.grid_time(timegrid.grid_index("ts", 3600), 3600))
    assert back.where("ts <> back").isEmpty()
    slots = spark.sql("select timestamp_ntz'2024-01-01 23:45:10' ts").select(timegrid.slot_of_day("ts", 900).alias("s"))
    assert slots.first().s == 95
    index = spark.sql("select timestamp_ntz'2018-07-01' a, timestamp_ntz'2018-07-08' b")
    assert index.select(F.size(timegrid.time_range(F.col("a"), F.col("b"), 3600)).alias("n")).first().n == 169


def test_time_grid_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select timestamp'2018-11-04 05:30:00Z' i, timestamp_ntz'2018-11-04 01:30:00' n")
        got = df.select(timegrid.to_local("i").alias("l"), timegrid.grid_index("n", 60).alias("g"),
                        F.unix_seconds(timegrid.zone_bound("20180601", "Europe/Berlin")).alias("b")).first()
        assert got.l == dt.datetime(2018, 11, 4, 6, 30)
        assert got.g == int(dt.datetime(2018, 11, 4, 1, 30, tzinfo=dt.timezone.utc).timestamp()) // 60
        assert got.b == 1527804000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_labels(spark):
    got = spark.sql("select 'wind_OFF_shore' s").select(labels.display_label("s").alias("l")).first().l
    assert got == "Wind off shore"


def brute_force(values, start, lookback, step=3600):
    """Day by day over a dict date -> {slot: value} with the rules of the profile."""
    per, days = 86_400 // step, {}
    for i, v in enumerate(values):
        when = start + dt.timedelta(seconds=step * i)
        days.setdefault(when.date(), {})[(when.hour * 3600 + when.minute * 60) // step] = v

    def kind(d):
        if d.month == 12 and d.day in (24, 31) and d.weekday() != 6:
            return 1
        if d in {dt.date(2024, 1, 1), dt.date(2024, 3, 29), dt.date(2024, 4, 1)} or d.weekday() == 6:
            return 2
        return 1 if d.weekday() == 5 else 0

    out = {}
    for d in days:
        earlier = [e for e in sorted(days) if e < d and kind(e) == kind(d)][-lookback:]
        for s in days[d]:
            parts = [days[e].get(s) for e in earlier]
            ok = len(earlier) == lookback and None not in parts
            out[(d, s)] = float(np.mean(parts)) if ok else None
    return out, per


def test_profiles_equal_the_day_by_day_rule(readings):
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    data = [None if rng.random() < 0.02 else float(v) for v in rng.normal(size=24 * 100)]
    want, _ = brute_force(data, start, 3)
    got = profile.profiles(readings(data), lookback=3).collect()
    assert len(got) == len(data)
    for r in got:
        w = want[(r.ts.date(), r.ts.hour)]
        assert (r.pslp is None) if w is None else r.pslp == pytest.approx(w)


def test_too_few_days_give_null(readings):
    df = readings([1.0] * 24 * 21, start="2024-01-06 00:00:00")
    got = profile.profiles(df, lookback=3).where("day_type = 1").collect()
    assert all(r.pslp is None for r in got)


def test_null_slot_only_empties_that_slot(readings):
    data = [1.0] * 24 * 5
    data[7] = None
    got = profile.profiles(readings(data, start="2024-01-08 00:00:00"), lookback=3)
    day4 = {r.ts.hour: r.pslp for r in got.where("to_date(ts) = date'2024-01-11'").collect()}
    assert day4[7] is None and all(v == 1 for h, v in day4.items() if h != 7)


def partial(readings):
    first = [("2024-01-08 23:00:00", 100.0)]
    rest = [(dt.datetime(2024, 1, 9) + dt.timedelta(hours=h), 1.0) for h in range(24 * 4)]
    return readings(first + rest)


def test_partial_day_modes(readings):
    df = partial(readings)
    with pytest.raises(Exception, match="not a full day"):
        profile.profiles(df, lookback=1).collect()

    def after(mode, day, hour):
        got = profile.profiles(df, lookback=1, on_partial=mode)
        return got.where(f"ts = timestamp_ntz'2024-01-{day:02d} {hour:02d}:00:00'").first().pslp

    assert after("null", 9, 23) is None and after("skip", 9, 23) is None
    assert after("null", 10, 23) == 1 and after("skip", 10, 5) == 1
    assert profile.profiles(df, lookback=5).count() == 97  # never looked back at: no error
    with pytest.raises(ValueError):
        profile.profiles(df, on_partial="other")


def test_skip_looks_further_back(readings):
    rows = [(dt.datetime(2024, 1, 8 + d) + dt.timedelta(hours=h), float(d)) for d in range(4) for h in range(24)]
    rows = [r for r in rows if not (r[0].day == 10 and r[0].hour == 5)]
    got = profile.profiles(readings(rows), lookback=2, on_partial="skip")
    day = {r.ts.hour: r.pslp for r in got.where("to_date(ts) = date'2024-01-11'").collect()}
    assert set(day.values()) == {0.5}
    also = {r.ts.hour: r.pslp for r in got.where("to_date(ts) = date'2024-01-10'").collect()}
    assert set(also.values()) == {0.5}


def test_future_profiles(readings):
    data = [float(d) for d in range(31) for _ in range(24)]
    df = readings(data)  # 1 to 31 January 2024; the 31st is a Wednesday
    got = profile.future_profiles(df, lookback=3)
    days = {r.d: r.v for r in got.groupBy(F.to_date("ts").alias("d")).agg(F.avg("pslp").alias("v")).collect()}
    assert days == {dt.date(2024, 2, 1): 29, dt.date(2024, 2, 3): pytest.approx(19), dt.date(2024, 2, 4): pytest.approx(20)}
    assert profile.profile_for_date(df, "20240201").count() == 24
    for date, reason in (("20240202", "too far"), ("20231231", "before the data"), ("20240106", "fewer than")):
        with pytest.raises(Exception, match=f"no profile of a: .*{reason}"):
            profile.profile_for_date(df, date).collect()
        row, = profile.profile_for_date(df, date, on_missing="status").collect()
        assert reason in row.status and row.pslp is None
    with pytest.raises(ValueError, match="on_missing"):
        profile.profile_for_date(df, "20240101", on_missing="skip")
    single = profile.profile_for_date(df, "20240130")
    both = profile.profiles(df).where("to_date(ts) = date'2024-01-30'")
    assert {(r.ts, r.pslp) for r in single.collect()} == {(r.ts, r.pslp) for r in both.collect()}


def test_future_strict(readings):
    df = readings([1.0] * 24 * 5, start="2024-01-08 00:00:00")
    assert {r.day_type for r in profile.future_profiles(df).select("day_type").distinct().collect()} == {0}
    strict = profile.future_profiles(readings([1.0] * 24 * 8, start="2024-01-06 00:00:00"), strict=True)
    with pytest.raises(Exception, match="fewer than 3 days"):
        strict.collect()


def test_day_type_without_a_next_date_keeps_its_past(spark, readings):
    table = spark.createDataFrame(
        [("XX", dt.date(2024, 2, d), "Closed") for d in range(1, 9)], "country string, date date, name string")
    df = readings([1.0] * 24 * 31)
    past = profile.profiles(df, country="XX", holidays=table)
    assert past.where("day_type = 0 and pslp is not null").count() > 0
    future = profile.future_profiles(df, country="XX", holidays=table)
    assert {r.day_type for r in future.select("day_type").distinct().collect()} == {2}


def test_profile_of_scaled_is_scaled_profile(readings):
    rng = np.random.default_rng(8)
    df = readings({s: list(rng.normal(size=24 * 20)) for s in "xy"})
    rows = residual.residual_dataset(df).where("pslp is not null").collect()
    assert rows
    for r in rows:
        assert r.value == pytest.approx(r.pslp + r.residual)
        assert r.scaled == pytest.approx(r.scaled_pslp + r.scaled_residual)


def test_partial_days(readings):
    got = profile.partial_days(partial(readings), 24).collect()
    assert [(str(r.date), r.least_rows, r.most_rows) for r in got] == [("2024-01-08", 1, 1)]


def test_days_of_92_96_and_100_rows(readings):
    """The clock changes: an hour left out, and one that comes twice."""
    rows = [(dt.datetime(2024, 3, 30) + dt.timedelta(minutes=15 * i), 1.0) for i in range(3 * 96)]
    rows = [r for r in rows if not (r[0].day == 31 and r[0].hour == 2)]
    rows += [(r[0], 2.0) for r in rows if r[0].day == 1 and r[0].hour == 2]
    df = readings(rows)
    got = profile.partial_days(df).orderBy("date").collect()
    assert [(str(r.date), r.least_rows, r.most_rows) for r in got] == [("2024-03-31", 92, 92), ("2024-04-01", 100, 100)]
    assert [r.full for r in profile.day_table(df, 900).orderBy("date").collect()] == [True, False, False]


def test_a_step_that_is_not_the_data_raises(readings):
    df = readings([1.0] * 96 * 20, step=900)
    with pytest.raises(Exception, match="not a full day"):
        profile.profiles(df, step=3_600).collect()
    assert profile.profiles(df, step=900).where("pslp is not null").count() > 0


def test_areas_are_judged_by_their_own_dates(readings):
    long, short = readings([1.0] * 24 * 31), readings([2.0] * 24 * 20, area="b")
    got = profile.profile_for_date(long.union(short), "20240201", on_missing="status").collect()
    assert {(r.area, r.status) for r in got} == {("a", "ok"), ("b", "20240201 lies too far after the data")}
    assert sum(r.area == "a" for r in got) == 24
    with pytest.raises(Exception, match="no profile of b"):
        profile.profile_for_date(long.union(short), "20240201").collect()


def test_easter_in_any_year(spark):
    def easter(year):  # the anonymous Gregorian computus
        a, b, c = year % 19, year // 100, year % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = (a + 11 * h + 22 * w) // 451
        return (h + w - 7 * m + 114) // 31, (h + w - 7 * m + 114) % 31 + 1

    years = spark.range(1583, 9990).select(F.col("id").cast("int").alias("y"))
    for r in years.select("y", daytype.easter_sunday(F.col("y")).alias("d")).collect():
        assert (r.d.month, r.d.day) == easter(r.y)
    assert daytype.holiday_table(spark, 2501, 2501).count() == 9
    with pytest.raises(Exception, match="no Easter rule before 1583: 1582"):
        daytype.holiday_table(spark, 1582, 1582).collect()
    with pytest.raises(ValueError, match="holiday table"):
        daytype.holiday_table(spark, 2024, 2024, "FR")


def test_next_dates_with_a_table(spark):
    dates = spark.sql("select explode(sequence(date'2024-04-01', date'2024-06-01', interval 1 day)) date")
    table = daytype.holiday_table(spark, 2024, 2024)
    assert set(daytype.next_dates(dates, table).collect()) == set(daytype.next_dates(dates).collect())
    closed = spark.createDataFrame([("FR", dt.date(2024, 5, 8), "x")], "country string, date date, name string")
    got = {r.date: r.next_date for r in daytype.next_dates(dates, closed, "FR").collect()}
    assert got[dt.date(2024, 5, 7)] == dt.date(2024, 5, 9) and got[dt.date(2024, 5, 5)] == dt.date(2024, 5, 8)
