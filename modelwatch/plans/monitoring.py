"""One monitoring run: lookback, label-free metrics, drift against the frozen reference, run row."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.times import instant
from modelwatch.operators.drift import DEFAULT_RULES, TestRule, detect_drift, drift_summary, summary_document
from modelwatch.operators.proxy import summary
from modelwatch.operators.timewindows import MIN_SAMPLES, lookback


def monitoring_run(
    log: DataFrame,
    reference: DataFrame,
    features: Sequence[str],
    now: str | datetime | Column,
    lookback_hours: int = 24,
    categorical: Sequence[str] = (),
    rules: Sequence[TestRule] = DEFAULT_RULES,
    metadata: DataFrame | None = None,
    min_samples: int = MIN_SAMPLES,
) -> dict[str, DataFrame]:
    """``run`` (one row for the run table), ``features`` (one row per feature), ``document`` (nested summary).

    The metrics read the score columns and the drift reads the feature columns of the same time slice, so
    the slice is scanned by two disjoint column sets and nothing is cached. A slice under ``min_samples``
    rows gives a run row with status ``insufficient_data`` and without metrics.
    """
    rows = lookback(log, now, lookback_hours)
    judged = detect_drift(reference, rows, features, categorical, rules)
    folded = drift_summary(judged, features)
    stats = summary(rows).withColumn("_k", F.lit(1))
    drift = folded.select(
        "dataset_drift_detected", "feature_drift_ratio", "num_drifted_features", "drifted_features", F.lit(1).alias("_k")
    )
    enough = F.col("num_predictions") >= min_samples
    wide = stats.join(drift, "_k")
    values = [
        "positive_rate", "probability_mean", "probability_std", "entropy", "dataset_drift_detected",
        "feature_drift_ratio", "num_drifted_features", "drifted_features",
    ]
    at = instant(now)
    run = wide.select(
        F.sha2(F.concat_ws("|", at.cast("string"), F.lit(str(lookback_hours))), 256).alias("id"),
        at.alias("timestamp"),
        F.lit(lookback_hours).alias("lookback_hours"),
        "num_predictions",
        *[F.when(enough, F.col(c)).alias(c) for c in values],
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
    )
    document = summary_document(judged, folded, metadata).withColumn("timestamp", at.cast("string"))
    return {"run": run, "features": judged, "document": document}
