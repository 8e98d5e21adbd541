"""Time filters and train/evaluation splits. Interval ends follow each operation's own convention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.times import instant, interval, micros
from modelwatch.operators.ordered import plan_cuts, value_at_rank

MIN_SAMPLES = 200
MIN_EVAL_ROWS = 100
TRAIN_FRACTION = 0.7


def lookback(df: DataFrame, now: str | datetime | Column, hours: int = 24, time: str = "timestamp") -> DataFrame:
    """Rows strictly newer than ``now`` minus the lookback. The bound is a literal and reaches the scan."""
    return df.filter(F.col(time) > instant(now) - interval(hours, "HOUR"))


def recent_days(df: DataFrame, now: str | datetime | Column, days: int = 30, date: str = "application_date"):
    """Rows at or after ``now`` minus N days."""
    return df.filter(F.col(date) >= instant(now) - interval(days, "DAY"))


def recent_window(
    df: DataFrame, days: int = 30, date: str = "application_date", end: str | datetime | None = None
) -> DataFrame:
    """Rows in [end - days, end]; the end defaults to the newest row (a scalar subquery)."""
    stop = instant(end) if end is not None else df.agg(F.max(date)).scalar()
    return df.filter((F.col(date) >= stop - interval(days, "DAY")) & (F.col(date) <= stop))


def temporal_split(
    df: DataFrame,
    train_end: str | datetime,
    eval_start: str | datetime,
    eval_end: str | datetime,
    date: str = "application_date",
) -> DataFrame:
    """Add ``split``: train before ``train_end``, eval in [eval_start, eval_end), rows in neither dropped."""
    if _parse(eval_start) < _parse(train_end):
        raise ValueError(f"temporal leak: evaluation starts {eval_start}, before training ends {train_end}")
    at = F.col(date)
    in_train = at < instant(train_end)
    in_eval = (at >= instant(eval_start)) & (at < instant(eval_end))
    return df.filter(in_train | in_eval).withColumn("split", F.when(in_train, "train").otherwise("eval"))


def _parse(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def require_both_splits(split: DataFrame) -> None:
    """Raise when the training or the evaluation window is empty."""
    present = {r["split"] for r in split.select("split").distinct().collect()}
    for name in ("train", "eval"):
        if name not in present:
            raise ValueError(f"empty {name} window")


def split_points(
    df: DataFrame,
    fraction: float = TRAIN_FRACTION,
    date: str = "application_date",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """One row of cut points: training ends at the date of rank int(fraction * n), evaluation starts one
    second later and ends one second after the newest row. Counts include the rows that fall in the gap.

    The date at the rank is read first (one value), so the counts are a plain aggregation.
    """
    number = micros(date)
    cuts = plan_cuts(df, {"d": number}, rows_per_bucket)["d"]
    rank = F.floor(F.lit(fraction) * F.col("_all"))
    found = value_at_rank(df, date, rank, cuts, number).first()["value"]
    cut = F.lit(None if found is None else str(found)).cast(df.schema[date].dataType)
    second = F.expr("INTERVAL 1 SECOND")
    at = F.col(date)
    counted = df.filter(at.isNotNull()).agg(
        F.max(at).alias("_newest"),
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(at < cut, True)).alias("n_train"),
        F.count(F.when((at >= cut) & (at < cut + second), True)).alias("n_dropped_gap"),
        F.count(F.when(at >= cut + second, True)).alias("n_eval"),
    )
    return counted.select(
        cut.alias("train_end"),
        (cut + second).alias("eval_start"),
        (F.col("_newest") + second).alias("eval_end"),
        "n_total",
        "n_train",
        "n_dropped_gap",
        "n_eval",
    )


def dynamic_split(df: DataFrame, fraction: float = TRAIN_FRACTION, date: str = "application_date") -> DataFrame:
    """``temporal_split`` at the cut points of ``split_points``; the row of cut points is read first, so the
    bounds are literals in the plan."""
    points = split_points(df, fraction, date).first()
    return temporal_split(df, points["train_end"], points["eval_start"], points["eval_end"], date)


def eval_window(
    df: DataFrame,
    eval_start: str | datetime,
    eval_end: str | datetime,
    min_rows: int = MIN_EVAL_ROWS,
    date: str = "application_date",
) -> DataFrame:
    """Rows of the evaluation window; fewer than ``min_rows`` is an error."""
    rows = df.filter((F.col(date) >= instant(eval_start)) & (F.col(date) < instant(eval_end)))
    found = rows.count()
    if found < min_rows:
        raise ValueError(f"insufficient evaluation rows: {found}")
    return rows


def by_ids(df: DataFrame, ids: Sequence[str] | DataFrame, key: str = "prediction_id") -> DataFrame:
    """Rows with an id from a short list or from a table of ids."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def sample_guard(df: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row: row count and ``insufficient_data`` below the minimum."""
    counted = df.agg(F.count(F.lit(1)).alias("num_predictions"))
    status = F.when(F.col("num_predictions") < min_samples, "insufficient_data").otherwise("ok")
    return counted.withColumn("status", status)


def recent_volume(df: DataFrame, now: str | datetime | Column, hours: int = 24, time: str = "timestamp") -> DataFrame:
    """Number of rows in the last hours."""
    return lookback(df, now, hours, time).agg(F.count(F.lit(1)).alias("volume"))
