"""Streaming monitoring: ingest with quarantine, deduplication, windows, panes, drift, labels, alerts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modelwatch.functions.bins import N_BINS, histogram_counts, histogram_entropy
from modelwatch.operators.drift import binned_drift
from modelwatch.operators.labels import keep_last
from modelwatch.operators.validate import Rule, with_reasons
from modelwatch.streaming.jobs import each_batch, write_batch

BIN_NAMES = [f"bin_{i}" for i in range(N_BINS)]


def ingest(stream: DataFrame, rules: Sequence[Rule], good: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Split scored rows into accepted rows and rejects with reasons, into two tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = with_reasons(batch, rules).persist()
        try:
            write_batch(tagged.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), good, batch_id)
            write_batch(tagged.filter(F.size("reject_reasons") > 0), rejects, batch_id)
        finally:
            tagged.unpersist()

    return each_batch(stream, write, checkpoint)


def deduplicated(stream: DataFrame, delay: str, key: str = "prediction_id", time: str = "timestamp") -> DataFrame:
    """Each id once, as long as its copies arrive within the delay; older ids leave the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _pane_columns() -> list[Column]:
    """Sums that merge by addition; everything reported later is derived from them."""
    p = F.col("probability")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("prediction").alias("positives"),
        F.sum(p).alias("sum_p"),
        F.sum(p * p).alias("sum_pp"),
        *histogram_counts(p),
    ]


def panes(
    stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", by: Sequence[str] = ("model_version",),
    time: str = "timestamp",
) -> DataFrame:
    """Tumbling panes of mergeable sums. One row goes to one pane; a sliding day over five-minute steps would
    send it to 288 windows instead."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(*_pane_columns())
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *_names())


def _names() -> list[str]:
    return ["n", "positives", "sum_p", "sum_pp", *BIN_NAMES]


def merge_panes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics from summed panes: count, rate, mean, sample standard deviation, entropy."""
    return _metrics(rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _names()]), by)


def _metrics(summed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics from rows that hold the sums of their panes."""
    n = F.col("n").cast("double")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("sum_pp") - F.col("sum_p") * F.col("sum_p") / n) / (n - 1)))
    return summed.select(
        *by,
        F.col("n").alias("num_predictions"),
        (F.col("positives") / n).alias("positive_rate"),
        (F.col("sum_p") / n).alias("probability_mean"),
        F.sqrt(variance).alias("probability_std"),
        histogram_entropy([F.col(b) for b in BIN_NAMES]).alias("entropy"),
    )


def hourly_metrics(
    stream: DataFrame, delay: str = "1 hour", by: Sequence[str] = ("model_version",), time: str = "timestamp"
) -> DataFrame:
    """Tumbling hours: rows, positives and mean score, emitted once the watermark has passed the hour."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), *by)
    counted = grouped.agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("positives"), F.avg("probability").alias("mean_score")
    )
    return counted.select(F.col("window.start").alias("hour"), *by, "n", "positives", "mean_score")


def lookback_from_panes(rows: DataFrame, span_hours: float = 24, by: Sequence[str] = ("model_version",)) -> DataFrame:
    """Metrics over the hours that end with each pane: one row per pane, none is multiplied.

    Measures and bins are summed from a group's first pane on; a window is the difference between its pane's totals and
    those of the last pane that lies a whole span before. Score sums are totalled as decimals, so the difference loses nothing,
    however long the history. One shuffle by group; a group has one row per pane, whatever its traffic.
    """
    exact = {c: "decimal(38,18)" if c.startswith("sum_") else "bigint" for c in _names()}
    end = F.unix_micros(F.col("end").cast("timestamp"))
    length = round(span_hours * 3_600_000_000)
    ordered = Window.partitionBy(*by).orderBy("_end")
    total = rows.select(*by, F.col("end").alias("window_end"), end.alias("_end"), *[F.col(c).cast(k).alias(c) for c, k in exact.items()])
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = total.select(*by, "window_end", "_end", *[F.sum(c).over(upto).alias(c) for c in exact])
    before = F.last(F.struct(*exact)).over(ordered.rangeBetween(Window.unboundedPreceding, -length))
    total = total.withColumn("_before", before)
    within = [(F.col(c) - F.coalesce(F.col(f"_before.{c}"), F.lit(0).cast(k))).alias(c) for c, k in exact.items()]
    window = total.select(*by, "window_end", *within)
    return _metrics(window.withColumns({c: F.col(c).cast("double") for c in exact if c.startswith("sum_")}), [*by, "window_end"])


def trends_from_panes(rows: DataFrame, hours: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Trailing trends anchored at the newest pane end."""
    last = rows.agg(F.max("end")).scalar()
    member = F.array_compact(
        F.array(*[F.when(F.col("start") >= last - F.expr(f"INTERVAL {h} HOUR"), F.lit(h)) for h in sorted(hours)])
    )
    return merge_panes(rows.select(*_names(), F.explode(member).alias("window_hours")), ["window_hours"])


def windowed_bins(
    stream: DataFrame, features: Sequence[str], width: str = "1 day", delay: str = "1 hour", time: str = "timestamp"
) -> DataFrame:
    """Histogram counts per window, feature and bin - the mergeable form of the drift input."""
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("bin")) for f in features]
    )
    long = stream.withWatermark(time, delay).select(time, F.inline(cells)).filter("bin IS NOT NULL")
    grouped = long.groupBy(F.window(time, width), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "feature", "bin", "n")


def drift_stream(
    stream: DataFrame, reference_counts: DataFrame, features: Sequence[str], path: str, checkpoint: str, **windowing
) -> StreamingQuery:
    """Drift of each closed window against the frozen reference histogram.

    A closed window leaves the aggregation in one micro-batch, so a batch is judged as a table.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        found = binned_drift(
            batch, batch, features, ["start"], reference_counts=reference_counts, current_counts=batch
        )
        write_batch(found, path, batch_id)

    return each_batch(windowed_bins(stream, features, **windowing), judge, checkpoint)


def attach_labels(
    predictions: DataFrame,
    labels: DataFrame,
    prediction_delay: str = "1 hour",
    label_delay: str = "1 hour",
    bound: str = "7 days",
    key: str = "prediction_id",
) -> DataFrame:
    """Left outer stream-stream join: a label counts when it comes within ``bound`` after its prediction.

    State is kept for the bound only; later labels are attached by the batch join. Predictions without a
    label come out with NULL once the watermark has passed their bound.
    """
    left = predictions.withWatermark("timestamp", prediction_delay)
    right = labels.select(F.col(key).alias("_id"), "true_label", "label_timestamp").withWatermark(
        "label_timestamp", label_delay
    )
    in_time = (
        (F.col(key) == F.col("_id"))
        & (F.col("label_timestamp") >= F.col("timestamp"))
        & (F.col("label_timestamp") <= F.col("timestamp") + F.expr(f"INTERVAL {bound}"))
    )
    return left.join(right, in_time, "left_outer").drop("_id")


def latest_labels(
    stream: DataFrame, path: str, checkpoint: str, key: str = "prediction_id", time: str = "updated_at"
) -> StreamingQuery:
    """Change log of labels: each micro-batch is reduced to the last row per id and written to its own folder.

    No state is held. The current snapshot is the last row per id over the log; ``upsert_labels`` folds old
    batches into one.
    """
    return each_batch(stream, lambda batch, i: write_batch(keep_last(batch, [key], [time]), path, i), checkpoint)


def alerts_with_cooldown(
    stream: DataFrame, cooldown_hours: float, by: str = "model_version", time: str = "timestamp", delay: str = "1 hour"
) -> DataFrame:
    """At most one drift alert per model and cooldown, from a stream of drifted runs.

    The input is a run table (a few rows per model and hour), not a log. The state is one number per model.
    """
    cooldown = pd.Timedelta(hours=cooldown_hours)

    def emit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        times = sorted(t for frame in frames for t in frame[time])
        alerts = []
        for t in times:
            if last is None or t - last >= cooldown:
                alerts.append(t)
                last = t
        if last is not None:
            state.update((last.value // 1000,))
        if alerts:
            yield pd.DataFrame({by: [key[0]] * len(alerts), "alert_at": pd.Series(alerts, dtype="datetime64[ns]")})

    return (
        stream.withWatermark(time, delay)
        .groupBy(by)
        .applyInPandasWithState(
            emit, f"{by} string, alert_at timestamp", "last bigint", "append", GroupStateTimeout.NoTimeout
        )
    )
