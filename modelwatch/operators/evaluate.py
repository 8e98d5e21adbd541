"""Supervised evaluation: classification, calibration and ranking metrics per model and segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.bins import right_closed_bin
from modelwatch.operators.ordered import BUCKET, bucket_bound, plan_cuts, running_totals, with_bucket

MIN_SEGMENT_ROWS = 30
MIN_EVAL_ROWS = 30

COUNTS = ["num_samples", "true_negatives", "false_positives", "false_negatives", "true_positives"]


def _labeled(df: DataFrame, by: Sequence[str], label: str, prediction: str | None, score: str | None) -> DataFrame:
    columns = [F.col(label).cast("int").alias("_y")]
    if prediction:
        columns.append(F.col(prediction).cast("int").alias("_yhat"))
    if score:
        columns.append(F.col(score).cast("double").alias("_p"))
    return df.select(*by, *columns).filter("_y IS NOT NULL")


def _confusion(weight: Column | None = None) -> list[Column]:
    one = weight if weight is not None else F.lit(1).cast("bigint")
    y, yhat = F.col("_y"), F.col("_yhat")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, one)), F.lit(0).cast("bigint"))

    return [
        F.coalesce(F.sum(one), F.lit(0).cast("bigint")).alias("num_samples"),
        total((y == 0) & (yhat == 0)).alias("true_negatives"),
        total((y == 0) & (yhat == 1)).alias("false_positives"),
        total((y == 1) & (yhat == 0)).alias("false_negatives"),
        total((y == 1) & (yhat == 1)).alias("true_positives"),
    ]


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(tp * 2, tp * 2 + fp + fn),
        "leak_suspected": (F.col("num_samples") > 0) & (fp == 0) & (fn == 0),
    }


def confusion_matrix(
    df: DataFrame, by: Sequence[str] = (), label: str = "true_label", prediction: str = "prediction"
) -> DataFrame:
    """The four counts; always defined, also with a single class."""
    return _labeled(df, by, label, prediction, None).groupBy(*by).agg(*_confusion())


def classification_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "true_label", prediction: str = "prediction"
) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 (0 on 0/0) and the perfect-score alarm."""
    return confusion_matrix(df, by, label, prediction).withColumns(_rates())


def roc_auc(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "true_label",
    score: str = "probability",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Exact area under the ROC curve per group, ties at half weight; NULL with a single class.

    Rows are first combined to one per distinct score; cuts on the score split large groups over tasks.
    """
    rows = _labeled(df, by, label, None, score).filter("_p IS NOT NULL")
    cuts = plan_cuts(rows, ["_p"], rows_per_bucket)["_p"]
    scores = with_bucket(rows, "_p", cuts).groupBy(*by, BUCKET, "_p").agg(
        F.count(F.when(F.col("_y") == 1, True)).alias("_pos"), F.count(F.when(F.col("_y") == 0, True)).alias("_neg")
    )
    # The group totals keep both count columns in the offset branch, so both branches read one shuffle.
    ordered = running_totals(
        scores,
        by,
        ["_p"],
        sums={"_below": "_neg"},
        totals={"_all_pos": "_pos", "_all_neg": "_neg"},
        bucket=BUCKET if cuts else None,
        exclusive=True,
        offset_rows=None if by else bucket_bound(cuts),
    )
    pairs = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") * 0.5))
    possible = F.max("_all_pos").cast("double") * F.max("_all_neg").cast("double")
    return ordered.groupBy(*by).agg(F.try_divide(pairs, possible).alias("roc_auc"))


def brier_score(
    df: DataFrame, by: Sequence[str] = (), label: str = "true_label", score: str = "probability"
) -> DataFrame:
    """Mean squared difference between score and label."""
    error = F.col("_p") - F.col("_y")
    return _labeled(df, by, label, None, score).groupBy(*by).agg(F.avg(error * error).alias("brier_score"))


def calibration_curve(
    df: DataFrame, by: Sequence[str] = (), label: str = "true_label", score: str = "probability"
) -> DataFrame:
    """Per score bin (right-closed): rows, share of positives and mean score. Empty bins are absent."""
    rows = _labeled(df, by, label, None, score).withColumn("bin", right_closed_bin("_p"))
    return rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_y").alias("fraction_of_positives"),
        F.avg("_p").alias("mean_predicted_value"),
    )


def expected_calibration_error(
    df: DataFrame, by: Sequence[str] = (), label: str = "true_label", score: str = "probability"
) -> DataFrame:
    """Mean gap of the calibration curve over its non-empty bins: unweighted, and weighted by rows."""
    curve = calibration_curve(df, by, label, score)
    gap = F.abs(F.col("fraction_of_positives") - F.col("mean_predicted_value"))
    return curve.groupBy(*by).agg(
        F.avg(gap).alias("expected_calibration_error"),
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("weighted_calibration_error"),
    )


def evaluate(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "true_label",
    prediction: str = "prediction",
    score: str = "probability",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """All metrics per group from one scan and one chain of aggregations.

    Rows are combined map-side to one per distinct (group, score) with the four label/prediction counts. The
    area under the curve needs them in score order; every other metric is a sum over at most ten score bins
    per group. Rows without a score or a prediction are left out. An empty input without groups gives one row with status
    ``no_labels``.
    """
    by = list(by)
    rows = _labeled(df, by, label, prediction, score).filter("_p IS NOT NULL AND _yhat IS NOT NULL")
    cuts = plan_cuts(rows, ["_p"], rows_per_bucket)["_p"]
    y, yhat = F.col("_y"), F.col("_yhat")
    counts = {f"_n{i}{j}": F.count(F.when((y == i) & (yhat == j), True)) for i in (0, 1) for j in (0, 1)}
    cells = with_bucket(rows, "_p", cuts).groupBy(*by, BUCKET, "_p").agg(
        *[c.alias(n) for n, c in counts.items()]
    )
    pos, neg, p = F.col("_n10") + F.col("_n11"), F.col("_n00") + F.col("_n01"), F.col("_p")
    n = pos + neg
    ordered = running_totals(
        cells,
        by,
        ["_p"],
        sums={"_below": neg},
        totals={"_all_pos": pos, "_all_neg": neg},
        bucket=BUCKET if cuts else None,
        exclusive=True,
        offset_rows=None if by else bucket_bound(cuts),
    )
    binned = ordered.groupBy(*by, right_closed_bin("_p").alias("_bin")).agg(
        F.sum(n).alias("num_samples"),
        F.sum("_n00").alias("true_negatives"),
        F.sum("_n01").alias("false_positives"),
        F.sum("_n10").alias("false_negatives"),
        F.sum("_n11").alias("true_positives"),
        F.max("_all_pos").alias("_all_pos"),
        F.max("_all_neg").alias("_all_neg"),
        F.sum(pos * (p - 1.0) * (p - 1.0) + neg * p * p).alias("_squared"),
        F.sum(pos.cast("double") * (F.col("_below") + neg * 0.5)).alias("_pairs"),
        F.abs(F.sum(pos) / F.sum(n) - F.sum(n * p) / F.sum(n)).alias("_gap"),
    )
    zero = F.lit(0).cast("bigint")
    totals = binned.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in COUNTS],
        F.try_divide(F.sum("_squared"), F.sum("num_samples")).alias("brier_score"),
        F.avg("_gap").alias("expected_calibration_error"),
        F.try_divide(F.sum("_pairs"), F.max("_all_pos").cast("double") * F.max("_all_neg").cast("double")).alias(
            "roc_auc"
        ),
    )
    status = F.when(F.col("num_samples") == 0, "no_labels").otherwise("ok")
    return totals.withColumns({**_rates(), "status": status})


def melt_segments(df: DataFrame, segments: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, segment feature); NULL segments are left out."""
    text = df.select(*keep, *[F.col(s).cast("string").alias(s) for s in segments])
    return text.unpivot(list(keep), list(segments), "segment_feature", "segment").filter("segment IS NOT NULL")


def segment_metrics(
    df: DataFrame,
    segments: Sequence[str],
    by: Sequence[str] = (),
    min_rows: int = MIN_SEGMENT_ROWS,
    label: str = "true_label",
    prediction: str = "prediction",
    score: str = "probability",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Metrics per segment of every segment feature in one pass; segments under ``min_rows`` are left out."""
    long = melt_segments(df, segments, [*by, label, prediction, score])
    keys = [*by, "segment_feature", "segment"]
    found = evaluate(long, keys, label, prediction, score, rows_per_bucket)
    return found.filter(F.col("num_samples") >= min_rows).drop("status")


def compare_models(metrics: DataFrame, by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Challenger minus production per evaluation set, from metric rows labelled ``production``/``shadow``."""
    names = ["num_samples", "f1_score", "roc_auc", "brier_score"]

    def of(which: str, prefix: str) -> list[Column]:
        return [F.max(F.when(F.col(model) == which, F.col(c))).alias(f"{prefix}_{c}") for c in names]

    wide = metrics.groupBy(*by).agg(*of("production", "prod"), *of("shadow", "shadow"))
    prod_f1, shadow_f1 = F.col("prod_f1_score"), F.col("shadow_f1_score")
    return wide.withColumns(
        {
            "f1_improvement": shadow_f1 - prod_f1,
            "f1_improvement_pct": F.when(prod_f1 > 0, (shadow_f1 - prod_f1) / prod_f1 * 100.0).when(
                prod_f1 <= 0, F.lit(0.0)
            ),
            "roc_auc_improvement": F.col("shadow_roc_auc") - F.col("prod_roc_auc"),
            "brier_change": F.col("shadow_brier_score") - F.col("prod_brier_score"),
            "calibration_degraded": F.col("shadow_brier_score") > F.col("prod_brier_score"),
            "status": F.when(prod_f1.isNull() | shadow_f1.isNull(), "insufficient_data").otherwise("ok"),
        }
    )


def eval_validity(
    df: DataFrame, by: Sequence[str] = (), label: str = "true_label", min_rows: int = MIN_EVAL_ROWS
) -> DataFrame:
    """Is an evaluation set usable: labeled, large enough, more than one class. Issues as an array."""
    found = df.groupBy(*by).agg(
        F.count(label).alias("num_labeled"), F.count_distinct(label).cast("int").alias("num_classes")
    )
    n, classes = F.col("num_labeled"), F.col("num_classes")
    issues = F.array_compact(
        F.array(
            F.when(n == 0, "no_labeled_data"),
            F.when((n > 0) & (n < min_rows), "eval_too_small"),
            F.when((n > 0) & (classes < 2), "eval_single_class"),
        )
    )
    return found.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def f1_alerts(metrics: DataFrame, baseline: Column) -> DataFrame:
    """Alert level from the relative F1 change against a baseline value."""
    change = F.when(baseline > 0, (F.col("f1_score") - baseline) / baseline * 100.0)
    return metrics.withColumns(
        {
            "f1_change_pct": change,
            "f1_level": F.when(change <= -10, "critical").when(change <= -5, "warning").otherwise("normal"),
        }
    )
