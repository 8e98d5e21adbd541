"""Supervised evaluation queries over labeled documents scored by two models."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query, rounded
from modelwatch.operators import evaluate, model

BASE = (v.SCORED_SQL, v.LABELS_SQL, v.EVALUATED_SQL)

CONFUSION_SQL = """count(*) AS num_samples,
  count(*) FILTER (true_label = 0 AND prediction = 0) AS true_negatives,
  count(*) FILTER (true_label = 0 AND prediction = 1) AS false_positives,
  count(*) FILTER (true_label = 1 AND prediction = 0) AS false_negatives,
  count(*) FILTER (true_label = 1 AND prediction = 1) AS true_positives"""

RATES = {
    "accuracy": "coalesce((true_positives + true_negatives) / nullif(num_samples, 0), 0)",
    "precision": "coalesce(true_positives / nullif(true_positives + false_positives, 0), 0)",
    "recall": "coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0)",
    "f1_score": "coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0)",
}


def confusion_view(rows: str, by: str, name: str = "v_confusion") -> str:
    return f"{name} AS (SELECT {by}, {CONFUSION_SQL} FROM {rows} GROUP BY {by})"


def auc_view(rows: str, by: str, name: str = "v_auc") -> str:
    """Mann-Whitney form with average ranks."""
    return f"""{name} AS (
      SELECT {by}, CASE WHEN sum(true_label) > 0 AND sum(1 - true_label) > 0 THEN
        (sum(CASE WHEN true_label = 1 THEN rk ELSE 0 END) - sum(true_label) * (sum(true_label) + 1) / 2)
        / (sum(true_label) * sum(1 - true_label)) END AS roc_auc
      FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY probability)
                      + (count(*) OVER (PARTITION BY {by}, probability) - 1) / 2.0e0 AS rk FROM {rows})
      GROUP BY {by})"""


def calibration_view(rows: str, by: str, name: str = "v_curve") -> str:
    return f"""{name} AS (
      SELECT {by}, {v.right_bin_sql('probability')} AS bin, count(*) AS n, avg(true_label) AS fraction_of_positives,
             avg(probability) AS mean_predicted_value FROM {rows} GROUP BY ALL)"""


def full_views(rows: str, by: str):
    return (
        confusion_view(rows, by),
        auc_view(rows, by),
        calibration_view(rows, by),
        f"""v_ece AS (SELECT {by}, avg(abs(fraction_of_positives - mean_predicted_value)) AS expected_calibration_error,
              sum(n * abs(fraction_of_positives - mean_predicted_value)) / sum(n) AS weighted_error
            FROM v_curve GROUP BY {by})""",
        f"""v_brier AS (SELECT {by}, avg((probability - true_label) * (probability - true_label)) AS brier_score
            FROM {rows} GROUP BY {by})""",
        f"""v_metrics AS (SELECT c.*, {', '.join(f'{e} AS {n}' for n, e in RATES.items())}, roc_auc, brier_score,
              expected_calibration_error, num_samples > 0 AND false_positives = 0 AND false_negatives = 0
                AS leak_suspected
            FROM v_confusion c JOIN v_auc USING ({by}) JOIN v_ece USING ({by}) JOIN v_brier USING ({by}))""",
    )


METRIC_NAMES = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "brier_score", "expected_calibration_error"]
METRIC_OUT = ", ".join(v.r6(n) for n in METRIC_NAMES)
COUNT_NAMES = evaluate.COUNTS
MODEL_VIEWS = (*BASE, *full_views("v_evaluated", "model"))


@query("confusion_matrix", v.with_views(*MODEL_VIEWS) + f"SELECT model, {', '.join(COUNT_NAMES)} FROM v_metrics")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(v.evaluated(spark, sf), ["model"])


@query(
    "classification_metrics",
    v.with_views(*MODEL_VIEWS)
    + f"""SELECT model, {', '.join(COUNT_NAMES)}, {v.r6('accuracy')}, {v.r6('precision')}, {v.r6('recall')},
                 {v.r6('f1_score')}, leak_suspected FROM v_metrics""",
)
def classification_metrics(spark, sf):
    return rounded(evaluate.classification_metrics(v.evaluated(spark, sf), ["model"]))


@query("roc_auc", v.with_views(*MODEL_VIEWS) + f"SELECT model, {v.r6('roc_auc')} FROM v_metrics")
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(v.evaluated(spark, sf), ["model"]))


@query("roc_auc_bucketed", v.with_views(*MODEL_VIEWS) + f"SELECT model, {v.r6('roc_auc')} FROM v_metrics")
def roc_auc_bucketed(spark, sf):
    """Small buckets on purpose: the path that large inputs take."""
    return rounded(evaluate.roc_auc(v.evaluated(spark, sf), ["model"], rows_per_bucket=40))


@query(
    "roc_auc_large",
    f"""WITH v_rows AS (
          SELECT l_returnflag AS model, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS true_label,
                 l_extendedprice AS probability FROM lineitem),
        {auc_view('v_rows', 'model')}
        SELECT model, {v.r6('roc_auc')} FROM v_auc""",
)
def roc_auc_large(spark, sf):
    """Ranking metric with as many distinct scores as rows."""
    rows = v.lines(spark, sf).select(
        F.col("l_returnflag").alias("model"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("true_label"),
        F.col("l_extendedprice").alias("probability"),
    )
    return rounded(evaluate.roc_auc(rows, ["model"]))


@query("brier", v.with_views(*MODEL_VIEWS) + f"SELECT model, {v.r6('brier_score')} FROM v_metrics")
def brier(spark, sf):
    return rounded(evaluate.brier_score(v.evaluated(spark, sf), ["model"]))


@query(
    "calibration_curve",
    v.with_views(*MODEL_VIEWS)
    + f"SELECT model, bin, n, {v.r6('fraction_of_positives')}, {v.r6('mean_predicted_value')} FROM v_curve",
)
def calibration_curve(spark, sf):
    return rounded(evaluate.calibration_curve(v.evaluated(spark, sf), ["model"]))


@query(
    "ece",
    v.with_views(*MODEL_VIEWS)
    + f"SELECT model, {v.r6('expected_calibration_error')}, {v.r6('weighted_error')} FROM v_ece",
)
def ece(spark, sf):
    both = evaluate.expected_calibration_error(v.evaluated(spark, sf), ["model"])
    return rounded(both.withColumnRenamed("weighted_calibration_error", "weighted_error"))


@query(
    "full_evaluation",
    v.with_views(*MODEL_VIEWS)
    + f"SELECT model, {', '.join(COUNT_NAMES)}, {METRIC_OUT}, leak_suspected, 'ok' AS status FROM v_metrics",
)
def full_evaluation(spark, sf):
    return rounded(evaluate.evaluate(v.evaluated(spark, sf), ["model"]))


SEGMENT_BY = "model, segment_feature, segment"
SEGMENT_ROWS = """v_segments AS (
  SELECT model, 'lang' AS segment_feature, lang AS segment, true_label, probability, prediction FROM v_evaluated
  UNION ALL
  SELECT model, 'source' AS segment_feature, source AS segment, true_label, probability, prediction FROM v_evaluated)"""
SEGMENT_VIEWS = (*BASE, SEGMENT_ROWS, *full_views("v_segments", SEGMENT_BY))


@query(
    "segment_metrics",
    v.with_views(*SEGMENT_VIEWS)
    + f"""SELECT {SEGMENT_BY}, {', '.join(COUNT_NAMES)}, {METRIC_OUT}, leak_suspected FROM v_metrics
          WHERE num_samples >= 30""",
)
def segment_metrics(spark, sf):
    return rounded(evaluate.segment_metrics(v.evaluated(spark, sf), ["lang", "source"], ["model"]))


COMPARISON_SQL = """v_comparison AS (
  SELECT p.num_samples AS prod_num_samples, p.f1_score AS prod_f1_score, p.roc_auc AS prod_roc_auc,
         p.brier_score AS prod_brier_score, s.num_samples AS shadow_num_samples, s.f1_score AS shadow_f1_score,
         s.roc_auc AS shadow_roc_auc, s.brier_score AS shadow_brier_score,
         s.f1_score - p.f1_score AS f1_improvement,
         CASE WHEN p.f1_score > 0 THEN (s.f1_score - p.f1_score) / p.f1_score * 100 ELSE 0.0 END AS f1_improvement_pct,
         s.roc_auc - p.roc_auc AS roc_auc_improvement, s.brier_score - p.brier_score AS brier_change,
         s.brier_score > p.brier_score AS calibration_degraded
  FROM v_metrics p JOIN v_metrics s ON p.model = 'production' AND s.model = 'shadow')"""
COMPARISON_NAMES = [
    f"{m}_{c}" for m in ("prod", "shadow") for c in ("f1_score", "roc_auc", "brier_score")
] + ["f1_improvement", "f1_improvement_pct", "roc_auc_improvement", "brier_change"]


@query(
    "model_comparison",
    v.with_views(*MODEL_VIEWS, COMPARISON_SQL)
    + f"""SELECT prod_num_samples, shadow_num_samples, {', '.join(v.r6(n) for n in COMPARISON_NAMES)},
                 calibration_degraded, 'ok' AS status FROM v_comparison""",
)
def model_comparison(spark, sf):
    metrics = evaluate.evaluate(v.evaluated(spark, sf), ["model"])
    return rounded(evaluate.compare_models(metrics))


@query(
    "eval_validity",
    v.with_views(*BASE)
    + """SELECT source, count(true_label) AS num_labeled, CAST(count(DISTINCT true_label) AS INTEGER) AS num_classes,
                array_to_string(list_filter([
                  CASE WHEN count(true_label) = 0 THEN 'no_labeled_data' END,
                  CASE WHEN count(true_label) > 0 AND count(true_label) < 30 THEN 'eval_too_small' END,
                  CASE WHEN count(true_label) > 0 AND count(DISTINCT true_label) < 2 THEN 'eval_single_class' END],
                  lambda x: x IS NOT NULL), ',') AS issues,
                count(true_label) >= 30 AND count(DISTINCT true_label) >= 2 AS valid
         FROM v_scored LEFT JOIN v_labels USING (prediction_id) GROUP BY source""",
)
def eval_validity(spark, sf):
    rows = v.scored(spark, sf).join(v.labels(spark, sf).select("prediction_id", "true_label"), "prediction_id", "left")
    return evaluate.eval_validity(rows, ["source"]).withColumn("issues", F.array_join("issues", ","))


@query(
    "split_metrics",
    v.with_views(
        v.SCORED_SQL,
        v.LABELS_SQL,
        """v_split AS (SELECT *, CASE WHEN "timestamp" < TIMESTAMP '2024-01-15 00:00:00' THEN 'train' ELSE 'test' END
             AS split FROM v_scored JOIN v_labels USING (prediction_id))""",
        *full_views("v_split", "split"),
    )
    + f"SELECT split, num_samples, {METRIC_OUT} FROM v_metrics",
)
def split_metrics(spark, sf):
    """Metrics of the training and the test part side by side: one grouped plan instead of two passes."""
    rows = v.scored(spark, sf).join(v.labels(spark, sf).select("prediction_id", "true_label"), "prediction_id")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    split = rows.withColumn("split", F.when(F.col("timestamp") < cut, "train").otherwise("test"))
    return rounded(evaluate.evaluate(split, ["split"]).select("split", "num_samples", *METRIC_NAMES))


# ---- splits, training and replay -----------------------------------------------------------------------

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "n_digits", "n_upper"]


DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents_with_features(spark, sf):
    """Labeled documents with numeric text measures, over whole texts."""
    docs = v.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("prediction_id"),
        "lang",
        "n_chars",
        F.size(F.split("text", r"\s+")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", DIGITS, ""))).alias("n_digits"),
        (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).alias("n_upper"),
    )
    known = v.labels(spark, sf).select("prediction_id", F.col("toxic").alias("true_label"))
    return docs.join(known, "prediction_id")


@query(
    "stratified_split",
    """WITH drawn AS (
         SELECT CAST(doc_id AS VARCHAR) AS prediction_id, quality,
                ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 13))::BIGINT AS u FROM labels),
       ranked AS (
         SELECT *, row_number() OVER (PARTITION BY quality ORDER BY u, prediction_id) - 1 AS rk,
                count(*) OVER (PARTITION BY quality) AS n FROM drawn)
       SELECT prediction_id, quality, CASE WHEN rk < round(n * 0.2e0) THEN 'test' ELSE 'train' END AS split
       FROM ranked""",
)
def stratified_split(spark, sf):
    rows = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("prediction_id"), "quality")
    return model.stratified_split(rows, "quality", "prediction_id", 0.2, 42)


@query("rf_replay")
def rf_replay(spark, sf):
    """Two forests trained on the same rows and compared on one held-out set (rows only: trees are not SQL)."""
    rows = model.stratified_split(documents_with_features(spark, sf), "true_label", "prediction_id", 0.3, 42)
    train, held_out = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    production = model.fit_forest(train, DOC_FEATURES[:2])
    shadow = model.fit_forest(train, DOC_FEATURES)
    scored = model.replay(held_out, {"production": production, "shadow": shadow}, DOC_FEATURES)
    return rounded(evaluate.evaluate(scored, ["model"]))


@query(
    "replay_counts",
    """WITH known AS (
         SELECT CAST(d.doc_id AS VARCHAR) AS prediction_id, toxic AS true_label,
                ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || '|42'), 1, 13))::BIGINT AS u
         FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
       ranked AS (
         SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY u, prediction_id) - 1 AS rk,
                count(*) OVER (PARTITION BY true_label) AS n FROM known)
       SELECT model, count(*) AS n, CAST(sum(true_label) AS BIGINT) AS positives, 0 AS unscored
       FROM ranked, (SELECT unnest(['broad', 'narrow', 'single']) AS model) WHERE rk < round(n * 0.3e0) GROUP BY model""",
)
def replay_counts(spark, sf):
    """Three forests replayed on the same held-out rows in one pass: rows and class sums per model, and rows without a score."""
    rows = model.stratified_split(documents_with_features(spark, sf), "true_label", "prediction_id", 0.3, 42)
    train, held_out = rows.filter("split = 'train'").persist(), rows.filter("split = 'test'")
    chosen = {"broad": DOC_FEATURES, "narrow": DOC_FEATURES[:2], "single": DOC_FEATURES[:1]}
    fitted = {name: model.fit_forest(train, features) for name, features in chosen.items()}
    train.unpersist()
    scored = model.replay(held_out, fitted, DOC_FEATURES)
    missing = F.col("probability").isNull() | F.isnan("probability")
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("true_label").cast("bigint")).alias("positives"), F.count_if(missing).cast("int").alias("unscored")
    )


@query("feature_importance")
def feature_importance(spark, sf):
    fitted = model.fit_forest(documents_with_features(spark, sf), DOC_FEATURES)
    return rounded(model.top_features(model.feature_importance(spark, fitted, DOC_FEATURES), 5))
