"""What is written is read back: logs, decision tables, records, training rows, ids from time."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query
from modelwatch.operators import cleaning, labels, timewindows
from modelwatch.session import scratch_dir
from modelwatch.sources import readers, writers

P, D = v.PREDICTIONS_SQL, v.DECISIONS_SQL


@query(
    "log_round_trip",
    v.with_views(P)
    + """SELECT CAST("timestamp" AS DATE) AS "day", model_version, count(*) AS n, CAST(sum(prediction) AS BIGINT) AS positives,
                count(DISTINCT segment) AS segments, min("timestamp") AS first_at, max("timestamp") AS last_at
         FROM v_predictions GROUP BY ALL""",
)
def log_round_trip(spark, sf):
    """Scored rows appended in two parts to the log, which is partitioned by day, and read with its schema."""
    path = scratch_dir(spark, "log")
    rows = v.predictions(spark, sf)
    for part in (0, 1):
        writers.append_predictions(rows.where(F.pmod(F.xxhash64("prediction_id"), F.lit(2)) == part), path, ["segment"])
    schema = cleaning.canonical_log(rows, ["segment"]).withColumn("day", F.to_date("timestamp")).schema
    log = readers.read_predictions(spark, path, schema=schema)
    return log.groupBy("day", "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("prediction").cast("bigint")).alias("positives"),
        F.count_distinct("segment").alias("segments"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )


@query(
    "decisions_appended_once",
    v.with_views(D) + "SELECT action, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v_decisions GROUP BY action",
)
def decisions_appended_once(spark, sf):
    """Half of the decisions, then all of them: rows whose key is there already are not appended again."""
    path = scratch_dir(spark, "decisions")
    rows = v.decisions(spark, sf)
    writers.append_new(rows.where("id % 2 = 0"), None, path, ["id"])
    writers.append_new(rows, spark.read.parquet(path), path, ["id"])
    stored = readers.read_table(spark, path, rows.schema)
    return stored.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("bigint")).alias("ids"))


@query(
    "deployment_history",
    v.with_views(D)
    + """SELECT "timestamp" AS at, action, shadow_version FROM (
           SELECT "timestamp", action, CAST(max(id) AS VARCHAR) AS shadow_version FROM v_decisions WHERE action <> 'skip'
           GROUP BY ALL ORDER BY "timestamp" DESC, action LIMIT 10)""",
)
def deployment_history(spark, sf):
    """Decision records written as JSON lines and read back, newest first: a report of ten."""
    path = scratch_dir(spark, "records")
    made = v.decisions(spark, sf).where("action <> 'skip'").groupBy("timestamp", "action").agg(F.max("id").cast("string").alias("shadow_version"))
    writers.write_records(made.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")), path)
    return readers.deployment_history(readers.read_decision_records(spark, path)).select("at", "action", "shadow_version")


TWICE_SQL = """v_twice AS (
  SELECT prediction_id, "timestamp", prediction, model_version FROM v_scored
  UNION ALL SELECT prediction_id, "timestamp" + INTERVAL 1 DAY, 1 - prediction, model_version FROM v_scored WHERE doc_id % 3 = 0)"""


@query(
    "training_rows",
    v.with_views(v.SCORED_SQL, v.LABELS_SQL, TWICE_SQL)
    + """SELECT t.prediction_id, t.prediction, l.true_label, l.days_delayed FROM v_twice t JOIN v_labels l USING (prediction_id)
         QUALIFY row_number() OVER (PARTITION BY t.prediction_id ORDER BY t."timestamp" DESC) = 1""",
)
def training_rows(spark, sf):
    """A third of the predictions were scored again a day later; the later score counts."""
    rows = v.scored(spark, sf).select("prediction_id", "timestamp", "prediction", "model_version", "doc_id")
    again = rows.where("doc_id % 3 = 0").withColumns({"timestamp": F.col("timestamp") + F.expr("INTERVAL 1 DAY"), "prediction": 1 - F.col("prediction")})
    found = labels.training_rows(rows.unionByName(again), v.labels(spark, sf))
    return found.select("prediction_id", "prediction", "true_label", "days_delayed")


@query(
    "training_duplicates",
    v.with_views(v.SCORED_SQL, TWICE_SQL) + "SELECT CAST(count(*) - count(DISTINCT prediction_id) AS BIGINT) AS duplicate_rows FROM v_twice",
)
def training_duplicates(spark, sf):
    """How many repeated predictions the training rows leave out."""
    rows = v.scored(spark, sf).select("prediction_id", "doc_id")
    return labels.duplicate_count(rows.unionByName(rows.where("doc_id % 3 = 0")), ["prediction_id"])


@query(
    "eval_window",
    v.with_views(v.SCORED_SQL)
    + """SELECT prediction_id, application_date FROM v_scored
         WHERE application_date >= TIMESTAMP '2024-01-02 12:00:00' AND application_date < TIMESTAMP '2024-01-08 00:00:00'""",
)
def eval_window(spark, sf):
    """Rows of an evaluation window, start in, end out."""
    found = timewindows.eval_window(v.scored(spark, sf), "2024-01-02 12:00:00", "2024-01-08 00:00:00", 10)
    return found.select("prediction_id", "application_date")


@query(
    "time_based_ids",
    v.with_views(P) + """SELECT prediction_id, 'pred_' || strftime("timestamp", '%Y%m%d_%H%M%S_%f') AS time_id FROM v_predictions""",
)
def time_based_ids(spark, sf):
    """The readable id form, to the microsecond."""
    return v.predictions(spark, sf).select("prediction_id", cleaning.time_based_id("timestamp").alias("time_id"))
