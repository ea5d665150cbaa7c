"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Average month and year lengths in days.
DAYS_PER_MONTH = 365.2425 / 12
DAYS_PER_YEAR = 365.243

# Contract statuses, the most telling first.
STATUS_ORDER = ("Active", "Signed", "Completed", "Demand")

WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; NULL where b is zero."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def month_of_days(days_ago: str | Column, rounding: str = "down") -> Column:
    """Month number of a positive days-ago count, rounded down or up."""
    months = as_column(days_ago) / F.lit(DAYS_PER_MONTH)
    return F.floor(months) if rounding == "down" else F.ceil(months)


def years_of_days(days_ago: str | Column) -> Column:
    return as_column(days_ago) / F.lit(DAYS_PER_YEAR)




def status_by_priority(col: str | Column, order: Sequence[str] = STATUS_ORDER) -> Column:
    """First status of `order` contained in a concatenated status, else the text itself."""
    c = as_column(col)
    out = c
    for status in reversed(order):
        out = F.when(c.contains(status), F.lit(status)).otherwise(out)
    return out


def mapped(col: str | Column, mapping: Mapping) -> Column:
    """Value map; anything outside the map becomes NULL."""
    c = as_column(col)
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out


def flag_symbol(col: str | Column, on: str = "✓", off: str = "✗") -> Column:
    return F.when(as_column(col), on).otherwise(off)


def timestamp_of(date: str | Column, hour: str | Column) -> Column:
    """Timestamp from a date and an hour column."""
    d = as_column(date).cast("date")
    return F.make_timestamp(
        F.year(d), F.month(d), F.dayofmonth(d), as_column(hour).cast("int"), F.lit(0), F.lit(0)
    )
