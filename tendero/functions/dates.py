"""Dates, stamps and the holiday calendar as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lx


def to_day(ts: Column) -> Column:
    return F.to_date(ts)


def parse_date(c: Column) -> Column:
    """The date in the first ten characters, NULL when there is none."""
    head = F.substring(c, 1, 10)
    return F.when(
        head.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), head.try_cast("date")
    )


def parse_stamp(c: Column) -> Column:
    """'20240131T235959Z' -> timestamp, NULL when it is no such stamp."""
    return F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def monday_on_or_after(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "MON")


def day_offset(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def years_of(dates: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(dates, lambda d: F.year(d))))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by Gauss's rule of 1816.

    The century gives two constants, M for the moon and N for the weekday; the full
    moon is d days after 21 March and Sunday e days after the day that follows. Two
    corrections keep the date within its bounds.
    """
    century = F.floor(year / 100)
    m = F.pmod(15 + century - F.floor(century / 4) - F.floor((13 + 8 * century) / 25), F.lit(30))
    n = F.pmod(4 + century - F.floor(century / 4), F.lit(7))
    golden = F.pmod(year, F.lit(19))
    d = F.pmod(19 * golden + m, F.lit(30))
    e = F.pmod(2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) + 6 * d + n, F.lit(7))
    week_back = (e == 6) & ((d == 29) | ((d == 28) & (golden > 10)))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (d + e - F.when(week_back, 7).otherwise(0)).cast("int"))


def holidays_of(year: str, sunday: str) -> Column:
    """``array<struct(date, label, position)>`` of one year's holidays, from the
    names of the columns that hold the year and its Easter Sunday."""

    def entry(position: int, day: str, moved: bool, label: str) -> str:
        shown = f"next_day(date_sub({day}, 1), 'MON')" if moved else day
        return f"struct({shown} AS date, '{label}' AS label, {position} AS position)"

    fixed = [
        entry(position, f"make_date({year}, {month}, {day})", moved, label)
        for position, month, day, moved, label in lx.FIXED_HOLIDAYS
    ]
    movable = [
        entry(position, f"date_add({sunday}, {days})", moved, label)
        for position, days, moved, label in lx.EASTER_HOLIDAYS
    ]
    return F.expr(f"array({', '.join(fixed + movable)})")


def holiday_calendar(years: DataFrame, year: str = "year") -> DataFrame:
    """One row per holiday date of the given years: date, label, position.

    Two holidays on one date keep the place of the first and the name of the last.
    """
    rows = years.select(F.col(year).cast("int").alias("year")).distinct()
    rows = rows.withColumn("easter", easter(F.col("year")))
    exploded = rows.select(
        F.explode(holidays_of("year", "easter")).alias("h")
    ).select("h.*")
    return exploded.groupBy("date").agg(
        F.max_by("label", "position").alias("label"), F.min("position").alias("position")
    )


def years_between(spark: SparkSession, first: date, last: date) -> DataFrame:
    """The years of a date range, both ends included."""
    return spark.range(first.year, last.year + 1).select(F.col("id").cast("int").alias("year"))
