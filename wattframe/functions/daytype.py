"""Day types and public holidays as column expressions.

The holiday test is arithmetic on the date, so classifying a frame needs
neither a join nor a shuffle; intermediate values are bound, so that the
expression stays small. Any other country works through a holiday table
``holidays(country, date, name)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WEEKDAY, SATURDAY, SUNDAY_OR_HOLIDAY = 0, 1, 2

# Nationwide public holidays since 1995.
FIXED_HOLIDAYS = {
    "DE": [
        (1, 1, "New Year's Day"),
        (5, 1, "Labour Day"),
        (10, 3, "German Unity Day"),
        (12, 25, "Christmas Day"),
        (12, 26, "Second Day of Christmas"),
    ],
}
# Days after Easter Sunday.
EASTER_HOLIDAYS = {
    "DE": [
        (-2, "Good Friday"),
        (1, "Easter Monday"),
        (39, "Ascension Day"),
        (50, "Whit Monday"),
    ],
}
# Holidays of a single year.
SINGLE_HOLIDAYS = {"DE": [("2017-10-31", "Reformation Day")]}


# First year of the Gregorian calendar's Easter rule.
FIRST_YEAR = 1583


def _whole(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and written once in the plan, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of any year of the Gregorian calendar, by Gauss's rule with its century terms; earlier years raise."""

    def checked(year: Column) -> Column:
        message = F.concat(F.lit(f"no Easter rule before {FIRST_YEAR}: "), year.cast("string"))
        return F.when(year >= FIRST_YEAR, year).when(year.isNotNull(), F.raise_error(message).cast("bigint"))

    def with_century(year: Column, century: Column) -> Column:
        leap = century - _whole(century, 4)
        moon = (15 + leap - _whole(13 + 8 * century, 25)) % 30
        return _bound((19 * (year % 19) + moon) % 30, lambda d: _bound(
            (2 * (year % 4) + 4 * (year % 7) + 6 * d + (4 + leap) % 7) % 7, lambda e: day(year, d, e)))

    def day(year: Column, d: Column, e: Column) -> Column:
        late = (e == 6) & ((d == 29) | ((d == 28) & (year % 19 > 10)))
        days = d + e - F.when(late, 7).otherwise(0)
        return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(22)), days.cast("int"))

    return _bound(_bound(year.cast("bigint"), checked), lambda y: _bound(_whole(y, 100), lambda c: with_century(y, c)))


def _check_country(country: str) -> None:
    if country not in FIXED_HOLIDAYS:
        raise ValueError(f"no built-in holidays for {country!r}; pass a holiday table instead")


def is_holiday(date: Column, country: str = "DE") -> Column:
    """True if ``date`` is a nationwide public holiday of ``country`` (P-08)."""
    _check_country(country)
    month_day = F.month(date) * 100 + F.dayofmonth(date)
    after_easter = F.datediff(date, easter_sunday(F.year(date)))
    single = [F.lit(day).cast("date") for day, _ in SINGLE_HOLIDAYS[country]]
    return (
        month_day.isin([m * 100 + d for m, d, _ in FIXED_HOLIDAYS[country]])
        | after_easter.isin([offset for offset, _ in EASTER_HOLIDAYS[country]])
        | date.isin(single)
    )


def day_type(date: Column, holiday: Column | None = None, country: str = "DE") -> Column:
    """0 = working day, 1 = Saturday, 2 = Sunday or public holiday (P-07).

    24 and 31 December count as Saturdays unless they fall on a Sunday. A null
    holiday flag counts as "no holiday".
    """
    holiday = is_holiday(date, country) if holiday is None else holiday
    holiday = F.coalesce(holiday, F.lit(False))
    weekday = F.weekday(date)
    eve = (F.month(date) == 12) & F.dayofmonth(date).isin(24, 31)
    return (
        F.when(date.isNull(), F.lit(None).cast("int"))
        .when(eve & (weekday != 6), SATURDAY)
        .when(holiday | (weekday == 6), SUNDAY_OR_HOLIDAY)
        .when(weekday == 5, SATURDAY)
        .otherwise(WEEKDAY)
    )


def next_same_type(date: Column, kind: Column | None = None, country: str = "DE") -> Column:
    """First date in ``(date, date + 7]`` of the same day type, null if none (P-10)."""
    kind = day_type(date, country=country) if kind is None else kind
    week = F.sequence(F.date_add(date, 1), F.date_add(date, 7))
    return F.array_min(F.filter(week, lambda d: day_type(d, country=country) == kind))


def next_dates(dates: DataFrame, holidays: DataFrame | None = None, country: str = "DE") -> DataFrame:
    """``(date, next_date)`` for the distinct dates of ``dates.date``, with the holidays of a table (P-10)."""
    if holidays is None:
        return dates.select("date").distinct().select("date", next_same_type(F.col("date"), country=country).alias("next_date"))
    week = F.explode(F.sequence(F.col("date"), F.date_add("date", 7)))
    days = dates.select(F.col("date").alias("_from")).distinct().select("_from", F.col("_from").alias("date")).select("_from", week.alias("date"))
    listed = holidays.where(F.col("country") == country).select("date", F.lit(True).alias("_holiday")).distinct()
    kinds = days.join(listed, "date", "left").select("_from", "date", day_type(F.col("date"), F.coalesce("_holiday", F.lit(False))).alias("_kind"))
    own = F.max(F.when(F.col("date") == F.col("_from"), F.col("_kind")))
    rows = kinds.groupBy("_from").agg(own.alias("_own"), F.collect_list(F.struct("date", "_kind")).alias("_week"))
    later = F.filter("_week", lambda x: (x["date"] > F.col("_from")) & (x["_kind"] == F.col("_own")))
    return rows.select(F.col("_from").alias("date"), F.array_min(F.transform(later, lambda x: x["date"])).alias("next_date"))


def holiday_table(spark: SparkSession, first_year: int, last_year: int, country: str = "DE") -> DataFrame:
    """``holidays(country, date, name)`` generated for a range of years (P-08)."""
    _check_country(country)
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    fixed = [
        F.struct(F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("date"), F.lit(name).alias("name"))
        for m, d, name in FIXED_HOLIDAYS[country]
    ]
    moving = [
        F.struct(F.date_add(easter_sunday(F.col("year")), offset).alias("date"), F.lit(name).alias("name"))
        for offset, name in EASTER_HOLIDAYS[country]
    ]
    single = [
        F.struct(F.lit(day).cast("date").alias("date"), F.lit(name).alias("name"))
        for day, name in SINGLE_HOLIDAYS[country]
    ]
    return (
        years.select("year", F.explode(F.array(*fixed, *moving, *single)).alias("h"))
        .where(F.year("h.date") == F.col("year"))
        .select(F.lit(country).alias("country"), "h.date", "h.name")
    )


def calendar(dates: DataFrame, holidays: DataFrame | None = None, country: str = "DE") -> DataFrame:
    """``calendar(country, date, weekday, holiday, category)`` of the distinct dates in ``dates.date`` (P-09)."""
    days = dates.select("date").distinct()
    if holidays is None:
        flagged = days.withColumn("holiday", is_holiday(F.col("date"), country))
    else:
        listed = holidays.where(F.col("country") == country).select("date", F.lit(True).alias("holiday")).distinct()
        flagged = days.join(listed, "date", "left").withColumn("holiday", F.coalesce("holiday", F.lit(False)))
    return flagged.select(
        F.lit(country).alias("country"),
        "date",
        F.weekday("date").alias("weekday"),
        "holiday",
        day_type(F.col("date"), F.col("holiday")).alias("category"),
    )
