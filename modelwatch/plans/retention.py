"""Retention: keep the newest days of a run table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.times import instant, interval


def keep_recent(df: DataFrame, now: str | datetime | Column, days: int = 90, time: str = "timestamp") -> DataFrame:
    """Rows not older than ``days``; on date-partitioned tables this prunes whole partitions."""
    return df.filter(F.col(time) >= instant(now) - interval(days, "DAY"))
