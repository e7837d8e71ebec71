"""Dates and schedules.  Every function takes an explicit ``as_of`` date.

Nothing here reads the clock, so any past day can be recomputed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY")
WEEKLY_DAY = 4  # Friday, Monday being 0
MONTHLY_DAY = 5


def day(as_of: dt.date | str) -> Column:
    """``as_of`` as a DATE literal."""
    return F.lit(dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


def previous_day(as_of) -> Column:
    return F.date_sub(day(as_of), 1)


def on_day(column: str, date: Column) -> Column:
    """Timestamps of one day, as a range that a scan can use."""
    return (F.col(column) >= date) & (F.col(column) < F.date_add(date, 1))


def in_last_month(column: str, as_of, inclusive_last_day: bool = False) -> Column:
    """Rows of the calendar month before ``as_of``.

    The upper bound is the last *date* of the month, so a timestamp after
    midnight of that day falls outside, as in the rules this follows;
    ``inclusive_last_day=True`` takes the whole last day.
    """
    month = F.add_months(day(as_of), -1)
    first, last = F.trunc(month, "month"), F.last_day(month)
    if inclusive_last_day:
        return (F.col(column) >= first) & (F.col(column) < F.date_add(last, 1))
    return F.col(column).between(first, last)


def business_friday(column: Column) -> Column:
    """The Friday of the Monday-based week a date lies in, also for weekends."""
    return F.next_day(F.to_date(F.date_trunc("week", column)), "FRI")


def is_weekday(column: Column) -> Column:
    return F.dayofweek(column).between(2, 6)


def frequency_of(column: Column) -> Column:
    """Upper-cased schedule; a missing one means daily."""
    return F.upper(F.coalesce(column, F.lit("DAILY")))


def is_due(frequency: Column, as_of: Column) -> Column:
    """True or false for a known schedule, NULL for an unknown one."""
    return (
        F.when(frequency == "DAILY", F.lit(True))
        .when(frequency == "WEEKLY", F.weekday(as_of) == WEEKLY_DAY)
        .when(frequency == "MONTHLY", F.dayofmonth(as_of) == MONTHLY_DAY)
    )


def since_days(column: str, as_of, days: int | None) -> Column:
    """On or after midnight ``days`` before ``as_of``; ``None`` keeps all rows."""
    if days is None:
        return F.lit(True)
    return F.col(column) >= F.date_sub(day(as_of), days)
