"""Time arithmetic on timestamp columns (with or without zone; the session zone is UTC)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(value: str | Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(as_column(value).cast("timestamp"))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Elapsed whole days, floored; not the number of calendar days touched."""
    return F.floor((micros(end) - micros(start)) / F.lit(MICROS_PER_DAY)).cast("int")


def interval(amount: int | float, unit: str) -> Column:
    """A literal day-time interval."""
    return F.expr(f"INTERVAL {amount} {unit}")


def instant(value: str | datetime | Column) -> Column:
    """A literal or column instant without zone, comparable with either timestamp type.

    Folded to a literal by the optimizer, so comparisons with it are pushed into file scans.
    """
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")
