"""Calendar keys and the windows that are anchored on each user's own first day."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shift_months(day: date, months: int) -> date:
    """``add_months`` for a plain date: the day is clamped to the target month's end."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class Period:
    """An inclusive span of days after a user's first day.

    The span runs from ``first + start`` to ``first + stop``; ``shift_months`` then
    moves both ends. The shift is applied to the already moved day, which matters at
    month ends: 30 Nov + 3 months + 12 months goes through 28 Feb.
    """

    name: str
    start: int = 0
    stop: int = 3
    shift_months: int = 0
    unit: str = "month"

    def __post_init__(self):
        if self.unit not in ("month", "day"):
            raise ValueError(f"unit must be 'month' or 'day', not {self.unit!r}")

    def _moved(self, first: Column, amount: int) -> Column:
        day = F.add_months(first, amount) if self.unit == "month" else F.date_add(first, amount)
        return F.add_months(day, self.shift_months) if self.shift_months else day

    def _moved_day(self, first: date, amount: int) -> date:
        day = shift_months(first, amount) if self.unit == "month" else first + timedelta(amount)
        return shift_months(day, self.shift_months)

    def contains(self, day: Column, first: Column) -> Column:
        """Is ``day`` inside this period of a user whose first day is ``first``?"""
        return day.between(self._moved(first, self.start), self._moved(first, self.stop))

    def span(self, first_from: date, first_to: date) -> tuple[date, date]:
        """Earliest and latest day the period can touch for first days in the range."""
        return self._moved_day(first_from, self.start), self._moved_day(first_to, self.stop)


def timestamp_bound(df: DataFrame, column: str, value: str | date) -> Column:
    """A literal of the column's own timestamp type, so the comparison reaches the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def between_days(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Rows of whole days ``first`` to ``last``, written as a range the scan can prune on."""
    return df.filter(
        (F.col(column) >= timestamp_bound(df, column, first))
        & (F.col(column) < timestamp_bound(df, column, last + timedelta(1)))
    )


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_of_text(text: Column) -> Column:
    """First day of a ``YYYY-MM`` text."""
    return F.to_date(F.concat(text, F.lit("-01")))


def months_inclusive(first: Column, last: Column) -> Column:
    """Number of calendar months touched from ``first`` to ``last``."""
    return (F.months_between(month_start(last), month_start(first)) + 1).cast("int")


def week_key(day: Column, iso_year: bool = False) -> Column:
    """Year and ISO week as one number.

    The default takes the calendar year, so 2018-12-31 (ISO week 1 of 2019) gives
    201801; ``iso_year`` pairs the week with the year it belongs to.
    """
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso_year else F.year(day)
    return (year * 100 + F.weekofyear(day)).cast("int")


def month_list(first: date, last: date) -> list[str]:
    """``YYYY-MM`` of every month from ``first`` to ``last``."""
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    return [shift_months(first.replace(day=1), i).strftime("%Y-%m") for i in range(count)]
