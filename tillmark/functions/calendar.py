"""Month arithmetic and the fiscal calendar.  A month is its first day (DATE)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def to_month(c: Column) -> Column:
    """Date or timestamp truncated to its month."""
    return F.trunc(c.cast("date"), "MM")


def month_number(date: Column) -> Column:
    """Months since year 0: consecutive months differ by exactly one."""
    return F.year(date) * F.lit(12) + F.month(date)


def month_timestamp(date: Column) -> Column:
    """Month as a timestamp, for sinks that want one."""
    return date.cast("timestamp")


@dataclass(frozen=True)
class FiscalCalendar:
    """Fiscal year y runs from ``start_month`` of y-1 to the month before it in y.

    Months outside ``first``..``last`` belong to no fiscal year (NULL).
    The defaults are fixed values: July start, 2022-01 to 2025-06, so that
    fiscal 2022 holds only its second half.
    """

    start_month: int = 7
    first: dt.date = dt.date(2022, 1, 1)
    last: dt.date = dt.date(2025, 6, 1)

    def __post_init__(self) -> None:
        if not 1 <= self.start_month <= 12:
            raise ValueError("start_month must be between 1 and 12")
        if self.first > self.last:
            raise ValueError("first month must not be after the last month")

    def fiscal_year(self, date: Column) -> Column:
        """Fiscal year of a month, computed rather than looked up."""
        shift = (13 - self.start_month) % 12
        inside = date.between(F.lit(self.first), F.lit(self.last))
        return F.when(inside, F.year(F.add_months(date, shift)))

    def months(self) -> dict[int, list[str]]:
        """Fiscal year -> its months as YYYY-MM, for looking at a calendar."""
        years: dict[int, list[str]] = {}
        first = self.first.year * 12 + self.first.month - 1
        for number in range(first, self.last.year * 12 + self.last.month):
            fiscal = (number + (13 - self.start_month) % 12) // 12
            years.setdefault(fiscal, []).append(f"{number // 12}-{number % 12 + 1:02d}")
        return years


DEFAULT_FISCAL_CALENDAR = FiscalCalendar()
