"""Label queries: joins, coverage, upsert, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query, rounded
from modelwatch.operators import labels, proxy

BASE = (v.SCORED_SQL, v.LABELS_SQL)
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus",
]


@query(
    "dedup_keep_last",
    f"""SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY {', '.join(f'{c} DESC' for c in LINE_ORDER)}) = 1""",
)
def dedup_keep_last(spark, sf):
    return labels.keep_last(v.lines(spark, sf), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query(
    "duplicate_count",
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def duplicate_count(spark, sf):
    return labels.duplicate_count(v.lines(spark, sf), ["l_orderkey", "l_linenumber"])


@query(
    "labeled_predictions",
    v.with_views(*BASE)
    + """SELECT prediction_id, "timestamp", model_version, prediction, round(probability + 1e-9, 6) AS probability,
                true_label, days_delayed
         FROM v_scored JOIN v_labels USING (prediction_id)""",
)
def labeled_predictions(spark, sf):
    out = labels.labeled_predictions(v.scored(spark, sf), v.labels(spark, sf))
    columns = ["prediction_id", "timestamp", "model_version", "prediction", "probability", "true_label", "days_delayed"]
    return rounded(out.select(*columns))


COVERAGE_SQL = """count(*) AS total_predictions, count(l.prediction_id) AS labeled_predictions,
  round(count(l.prediction_id) / count(*) + 1e-9, 6) AS coverage_rate,
  count(*) - count(l.prediction_id) AS unlabeled_predictions
  FROM v_scored s LEFT JOIN (SELECT DISTINCT prediction_id FROM v_labels) l USING (prediction_id)"""


@query("label_coverage", v.with_views(*BASE) + f"SELECT {COVERAGE_SQL}")
def label_coverage(spark, sf):
    return rounded(labels.label_coverage(v.scored(spark, sf), v.labels(spark, sf)))


@query(
    "label_coverage_by_source", v.with_views(*BASE) + f"SELECT source, lang, {COVERAGE_SQL} GROUP BY source, lang"
)
def label_coverage_by_source(spark, sf):
    return rounded(labels.label_coverage(v.scored(spark, sf), v.labels(spark, sf), ["source", "lang"]))


@query(
    "label_orphans",
    v.with_views(*BASE)
    + """SELECT prediction_id, true_label FROM v_labels WHERE prediction_id NOT IN (
           SELECT prediction_id FROM v_scored WHERE source <> 'src0')""",
)
def label_orphans(spark, sf):
    known = v.scored(spark, sf).filter("source <> 'src0'")
    return labels.label_orphans(known, v.labels(spark, sf)).select("prediction_id", "true_label")


@query(
    "split_overlap",
    v.with_views(v.PREDICTIONS_SQL)
    + """SELECT count(*) AS n_common FROM (
           SELECT prediction_id FROM v_predictions WHERE "timestamp" < TIMESTAMP '2024-01-20 00:00:00'
           INTERSECT
           SELECT prediction_id FROM v_predictions WHERE "timestamp" >= TIMESTAMP '2024-01-19 00:00:00')""",
)
def split_overlap(spark, sf):
    log = v.predictions(spark, sf)
    return labels.shared_ids(
        log.filter(F.col("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")),
        log.filter(F.col("timestamp") >= F.lit("2024-01-19 00:00:00").cast("timestamp_ntz")),
    )


@query(
    "accuracy_by_version",
    v.with_views(*BASE)
    + """SELECT model_version, round(avg(CASE WHEN prediction = true_label THEN 1.0e0 ELSE 0.0e0 END) + 1e-9, 6) AS accuracy,
                count(*) AS n
         FROM v_scored JOIN v_labels USING (prediction_id) GROUP BY model_version""",
)
def accuracy_by_version(spark, sf):
    return rounded(labels.accuracy_by_version(labels.labeled_predictions(v.scored(spark, sf), v.labels(spark, sf))))


UPDATES_SQL = """v_updates AS (
  SELECT prediction_id, toxic AS true_label, updated_at + INTERVAL 5 DAY AS updated_at FROM v_labels
  WHERE days_delayed >= 3
  UNION ALL
  SELECT prediction_id, 1 - toxic AS true_label, updated_at + INTERVAL 6 DAY AS updated_at FROM v_labels
  WHERE days_delayed >= 5
  UNION ALL
  SELECT 'new-' || prediction_id, toxic AS true_label, updated_at FROM v_labels)"""


def _updates(spark, sf):
    """Changed labels for late ids (for very late ones twice), and as many new ids as there are labels."""
    known = v.labels(spark, sf)

    def part(rows, label, days, key="prediction_id"):
        moved = F.col("updated_at") + F.expr(f"INTERVAL {days} DAY")
        return rows.select(F.expr(key).alias("prediction_id"), F.expr(label).alias("true_label"), moved.alias("updated_at"))

    return (
        part(known.filter("days_delayed >= 3"), "toxic", 5)
        .unionByName(part(known.filter("days_delayed >= 5"), "1 - toxic", 6))
        .unionByName(part(known, "toxic", 0, "concat('new-', prediction_id)"))
    )


def _stored(spark, sf):
    return v.labels(spark, sf).select("prediction_id", "true_label", "updated_at")


@query(
    "label_upsert",
    v.with_views(v.LABELS_SQL, UPDATES_SQL)
    + """SELECT prediction_id, true_label, updated_at FROM (
           SELECT prediction_id, true_label, updated_at, 0 AS u FROM v_labels
           UNION ALL SELECT prediction_id, true_label, updated_at, 1 AS u FROM v_updates)
         QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY u DESC, updated_at DESC) = 1""",
)
def label_upsert(spark, sf):
    return labels.upsert_labels(_stored(spark, sf), _updates(spark, sf))


@query(
    "label_conflicts",
    v.with_views(v.LABELS_SQL, UPDATES_SQL)
    + """SELECT prediction_id, arg_min(true_label, updated_at) AS old_label, arg_max(true_label, updated_at) AS new_label,
                count(*) AS n_versions
         FROM (SELECT prediction_id, true_label, updated_at FROM v_labels
               UNION ALL SELECT prediction_id, true_label, updated_at FROM v_updates)
         GROUP BY prediction_id HAVING min(true_label) <> max(true_label)""",
)
def label_conflicts(spark, sf):
    return labels.label_conflicts(_stored(spark, sf).unionByName(_updates(spark, sf)))


@query(
    "label_history",
    v.with_views(v.LABELS_SQL, UPDATES_SQL)
    + """SELECT prediction_id, true_label, updated_at, previous_label,
                previous_label IS NOT NULL AND previous_label <> true_label AS conflict
         FROM (SELECT *, lag(true_label) OVER (PARTITION BY prediction_id ORDER BY updated_at) AS previous_label
               FROM (SELECT prediction_id, true_label, updated_at FROM v_labels
                     UNION ALL SELECT prediction_id, true_label, updated_at FROM v_updates))""",
)
def label_history(spark, sf):
    return labels.label_history(_stored(spark, sf).unionByName(_updates(spark, sf)))


@query(
    "calibration_gap",
    v.with_views(*BASE)
    + f"""SELECT model_version, {v.r6('avg(prediction)', 'predicted_rate')}, {v.r6('avg(true_label)', 'actual_rate')},
                 {v.r6('abs(avg(prediction) - avg(true_label))', 'calibration_gap')}
          FROM v_scored JOIN v_labels USING (prediction_id) GROUP BY model_version""",
)
def calibration_gap(spark, sf):
    rows = labels.labeled_predictions(v.scored(spark, sf), v.labels(spark, sf))
    return rounded(proxy.calibration_gap(rows, ["model_version"]))
