"""The sample tables seen as the tables of a monitored model, in Spark and as SQL text.

Each ``X(spark, sf_dir)`` function has a SQL twin ``X_SQL`` that is a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions.bins import INTERIOR_EDGES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def r6(expr: str, name: str | None = None) -> str:
    """Round to six places in SQL, the way ``rounded`` does."""
    return f"round({expr} + 1e-9, 6) AS {name or expr}"


# ---- prediction log from events ------------------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("prediction_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("model_version"),
        F.when(F.col("value") >= 50, 1).otherwise(0).alias("prediction"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("probability"),
        F.col("ts").alias("application_date"),
        (F.col("user_id") % 5).cast("string").alias("segment"),
    )


PREDICTIONS_SQL = """v_predictions AS (
  SELECT CAST(event_id AS VARCHAR) AS prediction_id, ts AS "timestamp", event_type AS model_version,
         CASE WHEN value >= 50 THEN 1 ELSE 0 END AS prediction, least(value / 100.0, 1.0) AS probability,
         ts AS application_date, CAST(user_id % 5 AS VARCHAR) AS segment
  FROM events)"""


# ---- scored documents and their labels -----------------------------------------------------------------

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    probability = F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = start + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("prediction_id"),
        at.alias("timestamp"),
        F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("model_version"),
        (probability >= 0.5).cast("int").alias("prediction"),
        probability.alias("probability"),
        at.alias("application_date"),
        "lang",
        "source",
        "n_chars",
        "doc_id",
    )


SCORED_SQL = """v_scored AS (
  SELECT CAST(doc_id AS VARCHAR) AS prediction_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS "timestamp",
         'v' || CAST(doc_id % 3 AS VARCHAR) AS model_version,
         CASE WHEN least(n_chars / 4000.0, 1.0) >= 0.5 THEN 1 ELSE 0 END AS prediction,
         least(n_chars / 4000.0, 1.0) AS probability,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS application_date,
         lang, source, n_chars, doc_id
  FROM documents)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-03 06:00:00").cast("timestamp_ntz")
    at = start + F.make_dt_interval(hours=F.col("doc_id").cast("int"), mins=(F.col("doc_id") % 90 * 60).cast("int"))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("prediction_id"),
        F.col("quality").alias("true_label"),
        at.alias("label_timestamp"),
        F.lit("review").alias("label_source"),
        F.floor((F.lit(54) + F.col("doc_id") % 90) / 24).cast("int").alias("days_delayed"),
        at.alias("updated_at"),
        F.col("toxic"),
    )


LABELS_SQL = """v_labels AS (
  SELECT CAST(doc_id AS VARCHAR) AS prediction_id, quality AS true_label,
         TIMESTAMP '2024-01-03 06:00:00' + to_hours(CAST(doc_id + doc_id % 90 AS INTEGER)) AS label_timestamp,
         'review' AS label_source, CAST(floor((54 + doc_id % 90) / 24.0) AS INTEGER) AS days_delayed,
         TIMESTAMP '2024-01-03 06:00:00' + to_hours(CAST(doc_id + doc_id % 90 AS INTEGER)) AS updated_at, toxic
  FROM labels)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled documents scored by two models: production, and a challenger with a shifted score."""
    base = scored(spark, sf_dir).join(labels(spark, sf_dir).select("prediction_id", "true_label"), "prediction_id")
    challenger = F.least(F.col("probability") * 0.8 + 0.15, F.lit(1.0))
    models = F.array(
        F.struct(
            F.lit("production").alias("model"),
            F.col("probability").alias("probability"),
            F.col("prediction").alias("prediction"),
        ),
        F.struct(
            F.lit("shadow").alias("model"),
            challenger.alias("probability"),
            (challenger >= 0.5).cast("int").alias("prediction"),
        ),
    )
    return base.select(
        "prediction_id", "timestamp", "lang", "source", "true_label", F.inline(models)
    )


EVALUATED_SQL = """v_base AS (
  SELECT s.*, l.true_label FROM v_scored s JOIN v_labels l USING (prediction_id)),
v_evaluated AS (
  SELECT prediction_id, "timestamp", lang, source, true_label, 'production' AS model, probability, prediction
  FROM v_base
  UNION ALL
  SELECT prediction_id, "timestamp", lang, source, true_label, 'shadow' AS model,
         least(probability * 0.8e0 + 0.15e0, 1.0) AS probability,
         CASE WHEN least(probability * 0.8e0 + 0.15e0, 1.0) >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM v_base)"""


# ---- features from lineitem ----------------------------------------------------------------------------

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
CUTOVER = "1998-01-01 00:00:00"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def reference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(F.col("l_shipdate") < F.lit(CUTOVER).cast("timestamp_ntz"))


def current_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(F.col("l_shipdate") >= F.lit(CUTOVER).cast("timestamp_ntz"))


REFERENCE_SQL = f"""v_reference AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOVER}')"""
CURRENT_SQL = f"""v_current AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUTOVER}')"""


# ---- monitoring runs: one per day and model ------------------------------------------------------------

EDGE_SQL = [f"{e!r}e0" for e in INTERIOR_EDGES]


def left_bin_sql(p: str) -> str:
    """Number of interior edges at or below a score."""
    return "(" + " + ".join(f"CAST({p} >= {e} AS INTEGER)" for e in EDGE_SQL) + ")"


def right_bin_sql(p: str) -> str:
    """Number of interior edges strictly below a score."""
    return "(" + " + ".join(f"CAST({p} > {e} AS INTEGER)" for e in EDGE_SQL) + ")"


def entropy_sql(rows: str, by: str, score: str = "probability") -> str:
    """Subquery text: entropy of the ten-bin histogram per group ``by`` (a comma list, maybe empty)."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""(
    SELECT {keys}CASE WHEN min(tot) = 0 THEN 0.0 ELSE -sum(q / mass * ln(q / mass)) END AS entropy FROM (
      SELECT *, sum(q) OVER ({'PARTITION BY ' + by if by else ''}) AS mass FROM (
        SELECT {keys}b, tot, CASE WHEN tot > 0 THEN cnt / tot ELSE 0 END + 1e-10 AS q FROM (
          SELECT {keys}b, count(*) FILTER ({left_bin_sql(score)} = b AND {score} BETWEEN 0 AND 1) AS cnt
          FROM {rows} CROSS JOIN (SELECT unnest(range(10)) AS b) bins GROUP BY {keys}b)
        JOIN (SELECT {keys}count(*) FILTER ({score} BETWEEN 0 AND 1) AS tot FROM {rows} {group}) totals {join}))
    {group})"""


RUN_FEATURES = ["score", "segment"]
RUN_REFERENCE_END = "2024-01-08 00:00:00"


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their day and the two binned features that runs are compared on."""
    from modelwatch.functions.bins import left_closed_bin

    p = predictions(spark, sf_dir)
    return p.withColumns(
        {"day": F.date_trunc("day", "timestamp"), "score": left_closed_bin("probability").cast("string")}
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring runs: metrics and binned drift against the first week, per day and model."""
    from modelwatch.operators.drift import binned_drift, ratio_per_run
    from modelwatch.operators.proxy import summary

    items = run_items(spark, sf_dir)
    before = items.filter(F.col("timestamp") < F.lit(RUN_REFERENCE_END).cast("timestamp_ntz"))
    drift = ratio_per_run(binned_drift(before, items, RUN_FEATURES, ["day", "model_version"]), ["day", "model_version"])
    stats = summary(items, ["day", "model_version"])
    return stats.join(drift, ["day", "model_version"]).select(
        (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("timestamp"),
        "model_version",
        F.lit(24).alias("lookback_hours"),
        "num_predictions",
        "positive_rate",
        "probability_mean",
        "probability_std",
        "entropy",
        "dataset_drift_detected",
        "feature_drift_ratio",
        "num_drifted_features",
        "drifted_features",
    )


def newest_run(spark: SparkSession, sf_dir: str):
    """Time of the newest run, read from the log's newest row rather than from the computed runs."""
    newest = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return F.date_trunc("day", newest) + F.expr("INTERVAL 1 DAY")


RUNS_SQL = f"""v_items AS (
  SELECT *, date_trunc('day', "timestamp") AS "day", CAST({left_bin_sql('probability')} AS VARCHAR) AS score
  FROM v_predictions),
v_melted AS (
  SELECT "timestamp", "day", model_version, 'score' AS feature, score AS bin FROM v_items
  UNION ALL
  SELECT "timestamp", "day", model_version, 'segment' AS feature, segment AS bin FROM v_items),
v_ref_bins AS (
  SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS q
  FROM v_melted WHERE "timestamp" < TIMESTAMP '{RUN_REFERENCE_END}' GROUP BY feature, bin),
v_cur_bins AS (
  SELECT "day", model_version, feature, bin,
         count(*) / sum(count(*)) OVER (PARTITION BY "day", model_version, feature) AS p
  FROM v_melted GROUP BY "day", model_version, feature, bin),
v_run_grid AS (
  SELECT "day", model_version, feature, bin, max(p) AS p, max(q) AS q FROM (
    SELECT "day", model_version, feature, bin, p, 0.0 AS q FROM v_cur_bins
    UNION ALL
    SELECT k."day", k.model_version, r.feature, r.bin, 0.0 AS p, r.q
    FROM v_ref_bins r JOIN (SELECT DISTINCT "day", model_version FROM v_cur_bins) k ON TRUE)
  GROUP BY "day", model_version, feature, bin),
v_run_js AS (
  SELECT "day", model_version, feature,
         sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END
           + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END))) AS drift_score
  FROM v_run_grid GROUP BY "day", model_version, feature),
v_run_drift AS (
  SELECT "day", model_version, CAST(count(*) FILTER (drift_score >= 0.1) AS INTEGER) AS num_drifted_features,
         count(*) FILTER (drift_score >= 0.1) / count(*) AS feature_drift_ratio,
         string_agg(feature, ',' ORDER BY feature) FILTER (drift_score >= 0.1) AS drifted_features
  FROM v_run_js GROUP BY "day", model_version),
v_run_stats AS (
  SELECT "day", model_version, count(*) AS num_predictions, avg(prediction) AS positive_rate,
         avg(probability) AS probability_mean, stddev_samp(probability) AS probability_std
  FROM v_items GROUP BY "day", model_version),
v_run_entropy AS (SELECT * FROM {entropy_sql('v_items', '"day", model_version')}),
v_runs AS (
  SELECT "day" + INTERVAL 1 DAY AS "timestamp", model_version, 24 AS lookback_hours, num_predictions, positive_rate,
         probability_mean, probability_std, entropy, feature_drift_ratio >= 0.5 AS dataset_drift_detected,
         feature_drift_ratio, num_drifted_features, coalesce(drifted_features, '') AS drifted_features
  FROM v_run_stats JOIN v_run_drift USING ("day", model_version) JOIN v_run_entropy USING ("day", model_version))"""


# ---- decisions and model versions from orders ----------------------------------------------------------

def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    action = F.when(status == "O", "promote").when(status == "F", "reject").otherwise("skip")
    trigger = F.when(priority == "1-URGENT", "drift_alert").when(priority == "2-HIGH", "manual").otherwise("scheduled")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("model_"), (F.col("o_custkey") % 20).cast("string")).alias("model_name"),
        F.col("o_orderdate").alias("timestamp"),
        trigger.alias("trigger_reason"),
        action.alias("action"),
        F.when(action == "reject", "metric_improvement").alias("failed_gate"),
        (F.col("o_orderkey") % 1000).alias("labeled_samples"),
        (F.col("o_totalprice") / 5000.0).alias("coverage_pct"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("feature_drift_ratio"),
        F.col("o_totalprice").alias("score"),
    )


DECISIONS_SQL = """v_decisions AS (
  SELECT o_orderkey AS id, 'model_' || CAST(o_custkey % 20 AS VARCHAR) AS model_name, o_orderdate AS "timestamp",
         CASE o_orderpriority WHEN '1-URGENT' THEN 'drift_alert' WHEN '2-HIGH' THEN 'manual' ELSE 'scheduled' END
           AS trigger_reason,
         CASE o_orderstatus WHEN 'O' THEN 'promote' WHEN 'F' THEN 'reject' ELSE 'skip' END AS action,
         CASE WHEN o_orderstatus = 'F' THEN 'metric_improvement' END AS failed_gate,
         o_orderkey % 1000 AS labeled_samples, o_totalprice / 5000.0 AS coverage_pct,
         (o_orderkey % 10) / 10.0 AS feature_drift_ratio, o_totalprice AS score
  FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model version per promotion; the newest of a model is in production, the others are archived."""
    from modelwatch.functions.times import micros
    from modelwatch.operators.ordered import row_ranks

    promoted = decisions(spark, sf_dir).filter("action = 'promote'")
    ranked = row_ranks(
        promoted, ["model_name"], ["timestamp", "id"], [micros("timestamp"), F.col("id")], "nth", total="n_versions"
    )
    return ranked.select(
        "model_name",
        (F.col("nth") + 1).cast("int").alias("version"),
        F.when(F.col("nth") + 1 == F.col("n_versions"), "Production").otherwise("Archived").alias("stage"),
        F.col("timestamp").alias("trained_at"),
        F.col("timestamp").alias("promoted_at"),
        F.when(F.col("nth") + 1 < F.col("n_versions"), F.col("timestamp")).alias("archived_at"),
        (F.col("score") / 500000.0).alias("f1_score"),
        F.col("id").alias("decision_id"),
        F.col("timestamp").alias("updated_at"),
    )


VERSIONS_SQL = """v_promoted AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY "timestamp", id) AS nth,
         count(*) OVER (PARTITION BY model_name) AS n_versions
  FROM v_decisions WHERE action = 'promote'),
v_versions AS (
  SELECT model_name, CAST(nth AS INTEGER) AS version,
         CASE WHEN nth = n_versions THEN 'Production' ELSE 'Archived' END AS stage,
         "timestamp" AS trained_at, "timestamp" AS promoted_at,
         CASE WHEN nth < n_versions THEN "timestamp" END AS archived_at, score / 500000.0 AS f1_score,
         id AS decision_id, "timestamp" AS updated_at
  FROM v_promoted)"""
