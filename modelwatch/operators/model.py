"""Training a challenger, batch scoring and replay on identical rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions.hashing import hash_bits
from modelwatch.operators.cleaning import medians
from modelwatch.operators.evaluate import eval_validity, evaluate
from modelwatch.operators.ordered import row_ranks


def stratified_split(
    df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42, rows_per_bucket: int | None = None
) -> DataFrame:
    """Add ``split``: the same share of every class goes to the test part.

    Rows are ranked inside their class by a hash of their key, so the split is exact, repeatable and does not
    depend on partitioning. A class of any size is ranked in buckets.
    """
    drawn = df.withColumn("_u", hash_bits(seed, key))
    ranked = row_ranks(
        drawn, [label], ["_u", key], [F.col("_u"), F.col("_u")], "_rank", "_of", rows_per_bucket=rows_per_bucket
    )
    in_test = F.col("_rank") < F.round(F.col("_of") * F.lit(test_fraction))
    return ranked.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_u", "_rank", "_of")


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str = "true_label",
    num_trees: int = 100,
    max_depth: int = 10,
    min_leaf: int = 2,
    seed: int = 42,
) -> PipelineModel:
    """Random forest on the training rows, grown level by level across the cluster.

    NULL and NaN features are filled with the exact medians of the training rows, in training and in scoring: no row is
    left out. The medians travel in the fitted pipeline; a feature without any value counts as 0.
    """
    missing = [c for c in [*features, label] if c not in train.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label))
    found = medians(rows, features)
    filled = ", ".join(
        f"coalesce(nanvl(cast(`{f}` as double), cast(NULL as double)), {0.0 if found[f] is None else float(found[f])!r}D) AS `_in_{f}`"
        for f in features
    )
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_in_{f}" for f in features], outputCol="_features", handleInvalid="error"),
        RandomForestClassifier(
            featuresCol="_features",
            labelCol=label,
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_class",
            numTrees=num_trees,
            maxDepth=max_depth,
            minInstancesPerNode=min_leaf,
            seed=seed,
        ),
    ]
    # Growing a forest passes over the rows many times.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def score(df: DataFrame, fitted: Transformer) -> DataFrame:
    """Add ``prediction`` (0/1) and ``probability`` of class 1."""
    plain = df.drop("prediction", "probability")
    out = fitted.transform(plain)
    return out.select(
        *plain.columns,
        F.col("_class").cast("int").alias("prediction"),
        vector_to_array("_probability")[1].alias("probability"),
    )


def score_with_python(df: DataFrame, predict_proba, features: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Score with any Python callable that maps a feature frame to P(1), in Arrow batches.

    The callable travels with the function; Spark broadcasts it when it is large.
    """

    @F.pandas_udf("double")
    def proba(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            yield pd.Series(predict_proba(frame))

    out = df.drop("prediction", "probability").withColumn("probability", proba(F.struct(*features)))
    return out.withColumn("prediction", (F.col("probability") >= cut).cast("int"))


def feature_importance(spark: SparkSession, fitted: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature; the list is as long as the feature list."""
    values = fitted.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(x)) for f, x in zip(features, values)], "feature string, importance double"
    ).orderBy(F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    """The n most important features (a top-k report)."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def replay(
    rows: DataFrame, models: Mapping[str, Transformer], features: Sequence[str], label: str = "true_label"
) -> DataFrame:
    """Score the same labeled rows with every model; one output row per (row, model).

    All models are applied to a row in one pass, so the rows are read once however many models there are.
    """
    missing = [c for c in [label, *features] if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns for replay: {missing}")
    if not models:
        raise ValueError("no models to replay")
    plain = rows.drop("prediction", "probability", "model")
    wide, scored = plain, []
    for i, (name, fitted) in enumerate(models.items()):
        out = fitted.transform(wide)
        one = F.struct(
            F.col("_class").cast("int").alias("prediction"), vector_to_array("_probability")[1].alias("probability"), F.lit(name).alias("model")
        )
        wide = out.select(*wide.columns, one.alias(f"_scored_{i}"))
        scored.append(f"_scored_{i}")
    return wide.select(*plain.columns, F.inline(F.array(*scored)))


def train_challenger(
    train: DataFrame,
    held_out: DataFrame,
    features: Sequence[str],
    label: str = "true_label",
    path: str | None = None,
    **params,
) -> tuple[PipelineModel | None, DataFrame]:
    """Validate the held-out rows, fit, evaluate and optionally save a challenger.

    Returns (model or None, metrics row). An unusable held-out set aborts before fitting; the returned row
    then carries the issues. A perfect confusion matrix raises the ``leak_suspected`` flag in the row.
    """
    validity = eval_validity(held_out, label=label)
    if not validity.first()["valid"]:
        return None, validity.withColumn("status", F.lit("invalid_eval_set"))
    fitted = fit_forest(train, features, label, **params)
    if path:
        fitted.write().save(path)
    return fitted, evaluate(score(held_out, fitted), label=label)
