"""Label-free metrics of a prediction log: distribution, entropy, trends and their rate of change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.bins import N_BINS, histogram_counts, histogram_entropy
from modelwatch.functions.times import interval, micros
from modelwatch.operators.ordered import (
    BUCKET,
    bucket_bound,
    plan_cuts,
    previous_values,
    quantile_picks,
    running_totals,
    with_bucket,
)

QUARTILES = {"probability_q25": 0.25, "probability_median": 0.5, "probability_q75": 0.75}


def moment_columns(prediction: str = "prediction", probability: str = "probability") -> list[Column]:
    """Count, positive rate, mean and sample standard deviation; all merge map-side."""
    return [
        F.count(F.lit(1)).alias("num_predictions"),
        F.avg(prediction).alias("positive_rate"),
        F.avg(probability).alias("probability_mean"),
        F.stddev_samp(probability).alias("probability_std"),
    ]


def distribution_stats(
    predictions: DataFrame, by: Sequence[str] = (), rows_per_bucket: int | None = None
) -> DataFrame:
    """Moments and exact quartiles per group, with a ``status`` that is ``no_data`` for an empty input.

    With few distinct scores everything is one aggregation with the built-in exact percentile. Beyond that,
    rows are combined to distinct scores, ranked in buckets, and moments and quartiles follow from those.
    """
    by = list(by)
    cuts = plan_cuts(predictions, ["probability"], rows_per_bucket)["probability"]
    if not cuts:
        quartiles = [F.percentile("probability", q).alias(n) for n, q in QUARTILES.items()]
        stats = predictions.groupBy(*by).agg(*moment_columns(), *quartiles)
    else:
        stats = _ranked_stats(predictions, by, cuts)
    return stats.withColumn("status", F.when(F.col("num_predictions") == 0, "no_data").otherwise("ok"))


def _ranked_stats(predictions: DataFrame, by: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """Moments and quartiles from one scan: distinct scores with their counts, in bucketed order."""
    p = F.col("probability")
    counts = with_bucket(predictions, "probability", cuts).groupBy(*by, BUCKET, "probability").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(p).alias("_n"),
        F.sum("prediction").alias("_pos"),
        F.count("prediction").alias("_judged"),
    )
    # All counts are totalled, so that the offset branch needs the same columns and reads the same shuffle.
    ranked = running_totals(
        counts,
        by,
        ["probability"],
        sums={"_upto": "_n"},
        totals={
            "_all": "_n",
            "_sum": F.col("_n") * p,
            "_all_rows": "_rows",
            "_all_pos": "_pos",
            "_all_judged": "_judged",
        },
        offset_rows=None if by else bucket_bound(cuts),
    )
    off = p - F.col("_sum") / F.col("_all")
    picks, interpolated = quantile_picks("probability", QUARTILES)
    n = F.max("_all")
    wide = ranked.groupBy(*by).agg(
        F.max("_all_rows").alias("num_predictions"),
        F.try_divide(F.max("_all_pos"), F.max("_all_judged")).alias("positive_rate"),
        F.try_divide(F.max("_sum"), n).alias("probability_mean"),
        F.when(n > 1, F.sqrt(F.sum(F.col("_n") * off * off) / (n - 1))).alias("probability_std"),
        *picks,
    )
    moments = ["num_predictions", "positive_rate", "probability_mean", "probability_std"]
    return wide.select(*by, *moments, *[c.alias(name) for name, c in interpolated.items()])


def probability_entropy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entropy of the ten-bin score histogram: one aggregation, merged map-side."""
    names = [f"bin_{i}" for i in range(N_BINS)]
    counts = predictions.groupBy(*by).agg(*histogram_counts("probability"))
    return counts.select(*by, histogram_entropy([F.col(n) for n in names]).alias("entropy"))


def summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments and entropy in one aggregation over one scan."""
    names = [f"bin_{i}" for i in range(N_BINS)]
    wide = predictions.groupBy(*by).agg(*moment_columns(), *histogram_counts("probability"))
    return wide.withColumn("entropy", histogram_entropy([F.col(n) for n in names])).drop(*names)


def trailing_trends(
    predictions: DataFrame, hours: Sequence[int] = (1, 6, 24), time: str = "timestamp"
) -> DataFrame:
    """Metrics over trailing windows that end at the newest row.

    One filter on the longest window reaches the scan; each remaining row is then counted in every window it
    falls in. The anchor is a scalar subquery. Windows without rows (empty input) report ``no_data``.
    """
    newest = predictions.agg(F.max(time)).scalar()
    recent = predictions.filter(F.col(time) > newest - interval(max(hours), "HOUR"))
    member = F.array_compact(
        F.array(*[F.when(F.col(time) > newest - interval(h, "HOUR"), F.lit(h)) for h in sorted(hours)])
    )
    exploded = recent.select("prediction", "probability", F.explode(member).alias("window_hours"))
    found = summary(exploded, ["window_hours"]).withColumnRenamed("num_predictions", "count")
    spark = predictions.sparkSession
    wanted = spark.createDataFrame([(int(h),) for h in hours], "window_hours int")
    return wanted.join(found, "window_hours", "left").select(
        "window_hours",
        F.coalesce("count", F.lit(0)).alias("count"),
        "positive_rate",
        "probability_mean",
        "probability_std",
        "entropy",
        F.when(F.col("count").isNull(), "no_data").otherwise("ok").alias("status"),
    )


def rate_of_change(
    runs: DataFrame,
    by: Sequence[str] = ("model_version",),
    time: str = "timestamp",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Change per hour of positive rate and mean score against the previous run of the same group.

    A run table has one row per group and time step, so a group is small. For a very long run table give
    ``rows_per_bucket``: groups are then cut along time.
    """
    cuts = plan_cuts(runs, {"t": micros(time)}, rows_per_bucket, distinct=False)["t"] if rows_per_bucket else []
    placed = with_bucket(runs, micros(time), cuts)
    before = {"_time": time, "_rate": "positive_rate", "_mean": "probability_mean"}
    paired = previous_values(placed, by, [time], before, bucket=BUCKET if cuts else None)
    hours = (micros(time) - micros("_time")) / F.lit(3_600_000_000)

    def change(now: str, before: str) -> Column:
        return F.when(hours > 0, (F.col(now) - F.col(before)) / hours).when(hours <= 0, F.lit(0.0))

    return paired.select(
        *by,
        time,
        change("positive_rate", "_rate").alias("positive_rate_change_per_hour"),
        change("probability_mean", "_mean").alias("probability_mean_change_per_hour"),
        hours.alias("time_delta_hours"),
        F.when(hours.isNull(), "insufficient_data").otherwise("ok").alias("status"),
    )


def proxy_report(predictions: DataFrame) -> DataFrame:
    """The combined report as rows: one for the whole input and one per trailing window."""
    whole = summary(predictions).select(
        F.lit("overall").alias("scope"),
        F.col("num_predictions").alias("count"),
        "positive_rate",
        "probability_mean",
        "probability_std",
        "entropy",
    )
    trends = trailing_trends(predictions).select(
        F.format_string("window_%dH", F.col("window_hours")).alias("scope"),
        "count",
        "positive_rate",
        "probability_mean",
        "probability_std",
        "entropy",
    )
    return whole.unionByName(trends)


def last_n_stats(
    predictions: DataFrame, n: int = 100, time: str = "timestamp", tie_break: str = "prediction_id"
) -> DataFrame:
    """Moments over the newest n rows (a top-k, so only n rows leave each task)."""
    newest = predictions.orderBy(F.col(time).desc(), F.col(tie_break).desc()).limit(n)
    return newest.agg(*moment_columns())


def hourly_resample(predictions: DataFrame, time: str = "timestamp") -> DataFrame:
    """Per clock hour: sum of predictions and mean score; hours without rows are present with 0 and NULL."""
    hourly = predictions.groupBy(F.date_trunc("hour", F.col(time)).alias("hour")).agg(
        F.sum("prediction").alias("positives"), F.avg("probability").alias("probability_mean")
    )
    span = predictions.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    calendar = span.select(
        F.explode(
            F.sequence(F.date_trunc("hour", "lo"), F.date_trunc("hour", "hi"), F.expr("INTERVAL 1 HOUR"))
        ).alias("hour")
    )
    return calendar.join(hourly, "hour", "left").select(
        "hour", F.coalesce("positives", F.lit(0)).alias("positives"), "probability_mean"
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class; the total is a scalar over the class counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def calibration_gap(labeled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Absolute difference between the predicted and the actual positive rate."""
    rates: Mapping[str, str] = {"predicted_rate": "prediction", "actual_rate": "true_label"}
    out = labeled.groupBy(*by).agg(*[F.avg(c).alias(n) for n, c in rates.items()])
    return out.withColumn("calibration_gap", F.abs(F.col("predicted_rate") - F.col("actual_rate")))
