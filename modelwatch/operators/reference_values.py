"""A frozen reference as a table of its distinct values, so that drift runs do not read its rows again.

The table holds (feature, bucket, value, count) in the order of buckets and values, and the cuts that made the buckets. A run melts and
counts the current rows alone and adds the stored counts; no sketch, melt or scan of the reference is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators import drift
from modelwatch.operators.ordered import BUCKET, bucket_bound, plan_cuts


@dataclass(frozen=True)
class ReferenceValues:
    """Where the values are, the features in their order, and each feature's cuts."""

    path: str
    features: list[str]
    cuts: dict[str, list[float]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"feature int, {BUCKET} int, value double, n_ref bigint").parquet(f"{self.path}/values")


def store_reference_values(reference: DataFrame, features: Sequence[str], path: str, rows_per_bucket: int | None = None) -> ReferenceValues:
    """Count the distinct values of numeric features once and write them below ``path``, which must be new."""
    features = list(features)
    cuts = plan_cuts(reference, drift.finite(features), rows_per_bucket)
    counts = drift.melted(reference, features, cuts, True).groupBy("feature", BUCKET, "value").agg(F.sum("n_ref").alias("n_ref"))
    counts.repartitionByRange("feature", BUCKET).sortWithinPartitions("feature", BUCKET, "value").write.parquet(f"{path}/values")
    spark = reference.sparkSession
    meta = spark.createDataFrame([(json.dumps({"features": features, "cuts": cuts}),)], "value string")
    meta.coalesce(1).write.text(f"{path}/cuts")
    return ReferenceValues(path, features, cuts)


def open_reference_values(spark: SparkSession, path: str) -> ReferenceValues:
    """A reference that was stored before."""
    found = json.loads(spark.read.text(f"{path}/cuts").first()[0])
    return ReferenceValues(path, found["features"], found["cuts"])


def drift_from_stored(
    stored: ReferenceValues,
    current: DataFrame,
    rules: Sequence[drift.TestRule] = drift.DEFAULT_RULES,
    overrides: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """One judged row per feature, as ``detect_drift`` gives it for numeric features.

    The stored cuts also deal out the current rows: values beyond the reference's range fall into its outermost buckets.
    """
    counted = drift.melted(current, stored.features, stored.cuts, False).groupBy("feature", BUCKET, "value").agg(F.sum("n_cur").alias("n_cur"))
    zero = F.lit(0).cast("bigint")
    both = stored.table(current.sparkSession).withColumn("n_cur", zero).unionByName(counted.withColumn("n_ref", zero))
    values = both.groupBy("feature", BUCKET, "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    bound = sum(bucket_bound(stored.cuts.get(f, ())) for f in stored.features)
    stats = drift.numeric_statistics(values, bucketed=any(stored.cuts.values()), offset_rows=bound)
    named = drift.name_features(stats, stored.features).withColumn("categorical", F.lit(False))
    return drift.select_tests(named, rules, overrides)
