"""Ground-truth labels: keep-last, join to predictions, coverage, upsert and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.times import micros, whole_days
from modelwatch.operators.ordered import BUCKET, plan_cuts, previous_values, with_bucket


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``, which must be total.

    The rank-1 filter is pushed below the shuffle (window group limit), so each task sends at most one row
    per key and a hot key stays small.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest_first)).filter("_rn = 1").drop("_rn")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key."""
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def labeled_predictions(
    predictions: DataFrame,
    labels: DataFrame,
    key: str = "prediction_id",
    order: Sequence[str] = ("updated_at",),
    columns: Sequence[str] = ("true_label", "days_delayed"),
) -> DataFrame:
    """Inner join of predictions with the last label per id."""
    last = keep_last(labels, [key], order).select(key, *columns)
    return predictions.join(last, key, "inner")


def training_rows(
    predictions: DataFrame,
    labels: DataFrame,
    key: str = "prediction_id",
    order: Sequence[str] = ("updated_at",),
    prediction_order: Sequence[str] = ("timestamp",),
    columns: Sequence[str] = ("true_label", "days_delayed"),
) -> DataFrame:
    """Labeled predictions with one row per id: of a repeated prediction the last counts.

    ``duplicate_count`` over the predictions tells how many repeats are left out.
    """
    per_key = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in prediction_order], *tie_break(predictions, key, prediction_order))
    last = predictions.withColumn("_rn", F.row_number().over(per_key)).filter("_rn = 1").drop("_rn")
    return labeled_predictions(last, labels, key, order, columns)


def tie_break(df: DataFrame, key: str, order: Sequence[str]) -> list[Column]:
    """The remaining columns, so that rows with equal order values come in a fixed order."""
    rest = [f.name for f in df.schema.fields if f.name not in {key, *order} and f.dataType.typeName() != "map"]
    return [F.col(c).desc() for c in rest]


def label_coverage(predictions: DataFrame, labels: DataFrame, by: Sequence[str] = (), key: str = "prediction_id"):
    """Predictions, labeled predictions, coverage rate (0 for an empty input) and the unlabeled rest."""
    known = labels.select(key).distinct().withColumn("_has", F.lit(1))
    out = predictions.select(*{key: None, **dict.fromkeys(by)}).join(known, key, "left").groupBy(*by)
    counts = out.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count("_has").alias("labeled_predictions")
    )
    rate = F.coalesce(F.try_divide("labeled_predictions", "total_predictions"), F.lit(0.0))
    return counts.withColumns(
        {
            "coverage_rate": rate,
            "unlabeled_predictions": F.col("total_predictions") - F.col("labeled_predictions"),
        }
    )


def label_orphans(predictions: DataFrame, labels: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Labels without a prediction."""
    return labels.join(predictions.select(key), key, "left_anti")


def accuracy_by_version(labeled: DataFrame, version: str = "model_version") -> DataFrame:
    """Share of right predictions per model version."""
    hit = (F.col("prediction") == F.col("true_label")).cast("double")
    return labeled.groupBy(version).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def with_delay(labels: DataFrame, predictions: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Whole days from prediction to label; NULL where the prediction is unknown."""
    scored = predictions.select(key, F.col("timestamp").alias("_scored_at"))
    joined = labels.drop("days_delayed").join(scored, key, "left")
    return joined.withColumn("days_delayed", whole_days("_scored_at", "label_timestamp")).drop("_scored_at")


def upsert_labels(
    current: DataFrame, updates: DataFrame, key: str = "prediction_id", order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """New snapshot: updates replace rows with the same id, other rows stay. ``order`` decides within updates.

    Both sides are reduced to one row per id map-side before they meet.
    """
    both = current.withColumn("_is_update", F.lit(0)).unionByName(updates.withColumn("_is_update", F.lit(1)))
    return keep_last(both, [key], ["_is_update", *order]).drop("_is_update")


def label_conflicts(
    history: DataFrame, key: str = "prediction_id", label: str = "true_label", order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """Ids whose label was stored with different values, with the first and the last one.

    Plain mergeable aggregates, so an id with very many versions is combined map-side.
    """
    moment: Column = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    seen = history.groupBy(key).agg(
        F.min_by(label, moment).alias("old_label"),
        F.max_by(label, moment).alias("new_label"),
        F.count(F.lit(1)).alias("n_versions"),
        F.min(label).alias("_lo"),
        F.max(label).alias("_hi"),
    )
    return seen.filter(F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


def label_history(
    history: DataFrame,
    key: str = "prediction_id",
    label: str = "true_label",
    time: str = "updated_at",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Every stored version with the label before it and whether the two differ.

    Versions are cut along their time, so an id with very many versions is spread over tasks.
    """
    cuts = plan_cuts(history, {"t": micros(time)}, rows_per_bucket, distinct=False)["t"]
    placed = with_bucket(history, micros(time), cuts)
    bucket = BUCKET if cuts else None
    paired = previous_values(placed, [key], [time], {"previous_label": label}, bucket=bucket).drop(BUCKET)
    changed = F.col("previous_label").isNotNull() & (F.col("previous_label") != F.col(label))
    return paired.withColumn("conflict", changed)


def shared_ids(left: DataFrame, right: DataFrame, key: str = "prediction_id") -> DataFrame:
    """One row: how many ids two sets have in common (0 when they are disjoint)."""
    return left.select(key).intersect(right.select(key)).agg(F.count(F.lit(1)).alias("n_common"))
