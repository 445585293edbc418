"""Fiscal-week arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKS_PER_YEAR = 52


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_ending(day) -> Column:
    """Saturday of the Sunday-started week that holds ``day``."""
    day = _col(day)
    return F.date_add(day, 7 - F.dayofweek(day))


def sunday_weeks(start, end) -> Column:
    """Number of Sundays crossed going from ``start`` to ``end`` (not whole 7-day spans)."""
    return F.floor(F.datediff(week_ending(end), week_ending(start)) / 7).cast("int")


def pack_week(year, week) -> Column:
    """yyyyww as an int."""
    return (_col(year) * 100 + _col(week)).cast("int")


def packed_year(period) -> Column:
    return F.floor(_col(period) / 100).cast("int")


def packed_week(period) -> Column:
    return (_col(period) % 100).cast("int")


def year_week_text(year, week) -> Column:
    """Six-character yyyyww text."""
    return F.concat(_col(year).cast("string"), F.lpad(_col(week).cast("string"), 2, "0"))


def week_gap(year, week, period, per_year: int = WEEKS_PER_YEAR) -> Column:
    """Weeks from packed ``period`` to (year, week), counting ``per_year`` weeks a year."""
    return ((_col(year) - packed_year(period)) * per_year + (_col(week) - packed_week(period))).cast("int")


def week_filter(weeks, year="fiscal_year", week="fiscal_week") -> Column:
    """Predicate for one fiscal year and an inclusive week range: ``(year, low, high)``."""
    y, low, high = weeks
    return (_col(year) == y) & _col(week).between(low, high)


def calendar_ranks(cal: DataFrame) -> DataFrame:
    """Calendar (one row per fiscal week) reduced to fiscal_year, fiscal_week and its running number.

    The rank window has no partition key: it runs over the weeks of the calendar, which time bounds.
    """
    by_week = Window.orderBy("fiscal_year", "fiscal_week")
    return cal.select("fiscal_year", "fiscal_week", F.row_number().over(by_week).alias("week_rank"))


def week_array(weeks: DataFrame, *columns: str) -> Column:
    """All rows of a small calendar frame as one sorted array column (scalar subquery).

    Exploding it builds key x week spines without a join; its length is the number of weeks.
    """
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return weeks.agg(F.sort_array(F.collect_set(item))).scalar()


def week_places(weeks: DataFrame, column: str = "yw") -> tuple[Column, Callable[[Column], Column]]:
    """The packed weeks of a small frame as a sorted array, and the place of a week in it (from 0; NULL if it is not there).

    A place is one look-up in a second array, which has a slot for every number from the first week to the last.
    """
    held = weeks.agg(F.sort_array(F.collect_set(F.col(column).cast("int"))).alias("w"))
    numbers = F.sequence(F.get("w", F.lit(0)), F.array_max("w"))
    place = lambda n: F.when(F.array_contains("w", n), (F.array_position("w", n) - 1).cast("int"))
    both = held.select(F.struct("w", F.transform(numbers, place).alias("places"))).scalar()
    array = both["w"]
    return array, lambda w: F.get(both["places"], _col(w) - F.get(array, F.lit(0)))
