"""Row predicates shared by rules, reports and the findings view."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

ARCHIVE_TS = "ArchiveDate"
ARCHIVE_DAY = "archive_dt"  # the partition column of an archive


def is_blank(column: str | Column) -> Column:
    """NULL, empty or only spaces."""
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false when there are none."""
    return functools.reduce(operator.or_, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    """AND of the conditions; true when there are none."""
    return functools.reduce(operator.and_, conditions, F.lit(True))


def optional_filters(given: Mapping[str, tuple[str, object]]) -> Column:
    """AND of ``{column: (operator, value)}``, leaving out the values that are None."""
    compare = {"=": operator.eq, ">=": operator.ge, "<=": operator.le}
    return all_of(
        compare[op](F.col(column), F.lit(value))
        for column, (op, value) in given.items()
        if value is not None
    )


def business_columns(df: DataFrame) -> list[str]:
    """Columns a rule produced: no archive stamp or folder, no internal ``_`` columns."""
    return [c for c in df.columns if c not in (ARCHIVE_TS, ARCHIVE_DAY, "run_at") and not c.startswith("_")]


def contains_text(df: DataFrame, text: str | None, columns: list[str] | None = None) -> Column:
    """Case-blind search over all business columns; ``%`` and ``_`` are wildcards."""
    if not text or not text.strip():
        return F.lit(True)
    columns = columns or business_columns(df)
    row = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns])
    return F.lower(row).like(f"%{text.strip().lower()}%")


def date_scope(
    df: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    search: str | None = None,
    all_dates: bool = False,
    day_column: Column | None = None,
) -> Column:
    """Which archive days to show.

    All days, else a range, else one open bound, else all days when searching,
    else the latest day.  Days are those of the archive's partition column, so that
    only the needed folders are read; a table without one is read by its time stamps.
    """
    if day_column is None:
        day_column = F.col(ARCHIVE_DAY).cast("date") if ARCHIVE_DAY in df.columns else F.to_date(ARCHIVE_TS)
    day = day_column
    if all_dates:
        return F.lit(True)
    if date_from or date_to:
        bounds = []
        if date_from:
            bounds.append(day >= F.to_date(F.lit(date_from)))
        if date_to:
            bounds.append(day <= F.to_date(F.lit(date_to)))
        return all_of(bounds)
    if search and search.strip():
        return F.lit(True)
    return day == df.select(F.max(day)).scalar()
