"""Drift queries: line items before a cut-over date against later ones, as they are or perturbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query, rounded
from modelwatch.operators import drift, reference_values
from modelwatch.session import scratch_dir

FEATURES = v.LINE_FEATURES
SCALED = {"l_quantity": "l_quantity * 1.3e0", "l_discount": "l_discount + 0.02e0"}


def shifted(spark, sf):
    """Current rows with a scaled and a moved feature."""
    return v.current_features(spark, sf).withColumns(
        {"l_quantity": F.col("l_quantity") * 1.3, "l_discount": F.col("l_discount") + 0.02}
    )


def melt_sql(current: str = "v_current", exprs: dict | None = None, features=FEATURES) -> str:
    exprs = exprs or {}
    parts = [f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, 1 AS r, 0 AS c FROM v_reference" for f in features]
    parts += [
        f"SELECT '{f}' AS feature, CAST({exprs.get(f, f)} AS DOUBLE) AS value, 0 AS r, 1 AS c FROM {current}"
        for f in features
    ]
    return (
        "v_values AS (SELECT feature, value, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(c) AS BIGINT) AS n_cur FROM ("
        + "\nUNION ALL\n".join(parts)
        + ") GROUP BY feature, value)"
    )


CDF_SQL = """v_cdf AS (
  SELECT *, sum(n_ref) OVER w AS cr, sum(n_cur) OVER w AS cc,
         sum(n_ref) OVER (PARTITION BY feature) AS nr, sum(n_cur) OVER (PARTITION BY feature) AS nc,
         sum(n_ref * value) OVER (PARTITION BY feature) AS sr, lead(value) OVER w AS nxt
  FROM v_values WINDOW w AS (PARTITION BY feature ORDER BY value))"""

STATS_SQL = """v_stats AS (
  SELECT feature, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current,
         count(*) FILTER (n_ref > 0) AS n_distinct,
         coalesce(sum(abs(cr / nr - cc / nc) * (nxt - value)), 0.0) AS w1,
         max(abs(cr / nr - cc / nc)) AS ks_distance,
         sqrt(sum(n_ref * (value - sr / nr) * (value - sr / nr)) / max(nr)) AS ref_std,
         sqrt(greatest(0.0, sum(
           CASE WHEN n_ref > 0 THEN 0.5 * (n_ref / nr) * ln((n_ref / nr) / ((n_ref / nr + n_cur / nc) / 2)) ELSE 0 END
         + CASE WHEN n_cur > 0 THEN 0.5 * (n_cur / nc) * ln((n_cur / nc) / ((n_ref / nr + n_cur / nc) / 2)) ELSE 0 END
         ))) AS js_distance,
         sum(CASE WHEN n_ref > 0 THEN (n_cur - n_ref * nc / nr) * (n_cur - n_ref * nc / nr) / (n_ref * nc / nr) END)
           AS chi2,
         bool_or(n_ref = 0 AND n_cur > 0) AS unseen,
         max_by(n_ref, value) FILTER (n_ref > 0) AS top_ref, max_by(n_cur, value) FILTER (n_ref > 0) AS top_cur
  FROM v_cdf WHERE nr > 0 AND nc > 0 GROUP BY feature)"""

KS_P_SQL = """CASE WHEN ks_distance * ks_distance * n_reference * n_current / (n_reference + n_current) < 0.01 THEN 1.0
  ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k:
    (CASE WHEN k % 2 = 1 THEN 2.0e0 ELSE -2.0e0 END)
    * exp(-2.0e0 * k * k * ks_distance * ks_distance * n_reference * n_current / (n_reference + n_current)))))) END"""


def gamma_tail_sql(x2: str, df: str) -> str:
    """Upper chi-square tail by its finite sums: a Poisson sum for even degrees, and for odd ones the normal tail plus such
    a sum. The normal tail itself is below 1e-22 where it is set to 0."""
    x = f"({x2} / 2.0e0)"
    normal = f"""CASE WHEN {x} > 50 THEN 0.0 ELSE 1.0 - list_sum(list_transform(range(0, 401),
      lambda i: exp((i + 0.5e0) * ln({x}) - {x} - lgamma(i + 1.5e0)))) END"""
    even = f"""list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(k * ln({x}) - {x} - lgamma(k + 1.0e0))))"""
    odd = f"""{normal} + coalesce(list_sum(list_transform(range(1, CAST(({df} + 1) // 2 AS BIGINT)),
      lambda k: exp((k - 0.5e0) * ln({x}) - {x} - lgamma(k + 0.5e0)))), 0.0)"""
    return f"""CASE WHEN {x2} <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)) END"""


CHI_P_SQL = f"""CASE WHEN unseen THEN 0.0 WHEN n_distinct < 2 THEN 1.0
  ELSE {gamma_tail_sql('chi2', '(n_distinct - 1)')} END"""
Z_SQL = """coalesce((top_ref / n_reference - top_cur / n_current) / nullif(sqrt(
  ((top_ref + top_cur) / (n_reference + n_current)) * (1 - (top_ref + top_cur) / (n_reference + n_current))
  * (1.0e0 / n_reference + 1.0e0 / n_current)), 0), 0.0)"""


def plain_sql(*columns: str) -> str:
    return (
        v.with_views(v.REFERENCE_SQL, v.CURRENT_SQL, melt_sql(), CDF_SQL, STATS_SQL)
        + "SELECT feature, n_reference, n_current, "
        + ", ".join(columns)
        + " FROM v_stats"
    )


def _stats(spark, sf, *columns, rows_per_bucket=None):
    found = drift.feature_statistics(
        v.reference_features(spark, sf), v.current_features(spark, sf), FEATURES, rows_per_bucket=rows_per_bucket
    )
    return rounded(found.select("feature", "n_reference", "n_current", *columns))


@query(
    "drift_wasserstein",
    plain_sql(v.r6("w1"), v.r6("ref_std"), v.r6("w1 / greatest(ref_std, 0.001)", "wasserstein")),
)
def drift_wasserstein(spark, sf):
    return _stats(spark, sf, "w1", "ref_std", "wasserstein")


@query(
    "drift_wasserstein_bucketed",
    plain_sql(v.r6("w1"), v.r6("ref_std"), v.r6("w1 / greatest(ref_std, 0.001)", "wasserstein")),
)
def drift_wasserstein_bucketed(spark, sf):
    """Small buckets on purpose: the path that large inputs take."""
    return _stats(spark, sf, "w1", "ref_std", "wasserstein", rows_per_bucket=5000)


@query("drift_ks", plain_sql(v.r6("ks_distance"), v.r6(KS_P_SQL, "ks_p")))
def drift_ks(spark, sf):
    return _stats(spark, sf, "ks_distance", "ks_p")


@query("drift_js", plain_sql(v.r6("js_distance")))
def drift_js(spark, sf):
    return _stats(spark, sf, "js_distance")


def flag_sql(columns: str) -> str:
    values = """v_values AS (
      SELECT feature, value, count(*) FILTER (side = 'r') AS n_ref, count(*) FILTER (side = 'c') AS n_cur FROM (
        SELECT 'l_returnflag' AS feature, l_returnflag AS value, 'r' AS side FROM v_reference
        UNION ALL SELECT 'l_returnflag', l_returnflag, 'c' FROM v_current
        UNION ALL SELECT 'l_linestatus', l_linestatus, 'r' FROM v_reference
        UNION ALL SELECT 'l_linestatus', l_linestatus, 'c' FROM v_current) GROUP BY feature, value)"""
    cdf = """v_cdf AS (
      SELECT *, sum(n_ref) OVER (PARTITION BY feature) AS nr, sum(n_cur) OVER (PARTITION BY feature) AS nc
      FROM v_values)"""
    stats = """v_stats AS (
      SELECT feature, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current,
             count(*) FILTER (n_ref > 0) AS n_distinct, bool_or(n_ref = 0 AND n_cur > 0) AS unseen,
             sum(CASE WHEN n_ref > 0
                 THEN (n_cur - n_ref * nc / nr) * (n_cur - n_ref * nc / nr) / (n_ref * nc / nr) END) AS chi2,
             max_by(n_ref, value) FILTER (n_ref > 0) AS top_ref, max_by(n_cur, value) FILTER (n_ref > 0) AS top_cur
      FROM v_cdf GROUP BY feature)"""
    return v.with_views(v.REFERENCE_SQL, v.CURRENT_SQL, values, cdf, stats) + (
        f"SELECT feature, n_reference, n_current, {columns} FROM v_stats"
    )


def _flag_stats(spark, sf):
    features = ["l_returnflag", "l_linestatus"]
    return drift.feature_statistics(
        v.reference_features(spark, sf), v.current_features(spark, sf), features, categorical=features
    )


@query("drift_chi2", flag_sql(f"n_distinct, {v.r6('chi2')}, {v.r6(CHI_P_SQL, 'chi2_p')}"))
def drift_chi2(spark, sf):
    out = _flag_stats(spark, sf).select("feature", "n_reference", "n_current", "n_distinct", "chi2", "chi2_p")
    return rounded(out)


@query("drift_ztest", flag_sql(f"{v.r6(Z_SQL, 'z')}, {v.r6(gamma_tail_sql(f'(({Z_SQL}) * ({Z_SQL}))', '1'), 'z_p')}"))
def drift_ztest(spark, sf):
    return rounded(_flag_stats(spark, sf).select("feature", "n_reference", "n_current", "z", "z_p"))


SELECTED_SQL = f"""v_picked AS (
  SELECT *, CASE WHEN n_reference <= 1000 THEN
                   CASE WHEN n_distinct <= 2 THEN 'z' WHEN n_distinct <= 5 THEN 'chisquare' ELSE 'ks' END
                 WHEN n_distinct <= 5 THEN 'jensenshannon' ELSE 'wasserstein' END AS test,
         {Z_SQL} AS z, {KS_P_SQL} AS ks_p, {CHI_P_SQL} AS chi2_p
  FROM v_stats),
v_scored_tests AS (
  SELECT *, CASE WHEN n_reference <= 1000 THEN 0.05e0 ELSE 0.1e0 END AS threshold,
         CASE test WHEN 'z' THEN z WHEN 'chisquare' THEN chi2 WHEN 'ks' THEN ks_distance
                   WHEN 'jensenshannon' THEN js_distance ELSE w1 / greatest(ref_std, 0.001) END AS statistic,
         CASE test WHEN 'z' THEN {gamma_tail_sql('(z * z)', '1')} WHEN 'chisquare' THEN chi2_p WHEN 'ks' THEN ks_p END
           AS p_value
  FROM v_picked),
v_selected AS (
  SELECT *, coalesce(p_value, statistic) AS drift_score,
         CASE WHEN test = 'ks' THEN p_value <= threshold WHEN p_value IS NOT NULL THEN p_value < threshold
              ELSE statistic >= threshold END AS drifted
  FROM v_scored_tests)"""


def selected_views(exprs=None):
    return (v.REFERENCE_SQL, v.CURRENT_SQL, melt_sql(exprs=exprs), CDF_SQL, STATS_SQL, SELECTED_SQL)


SELECTED_OUT = f"""SELECT feature, test, threshold, {v.r6('statistic')}, {v.r6('drift_score')},
  drifted AS drift_detected, n_reference, n_current FROM v_selected"""
JUDGED = ["feature", "test", "threshold", "statistic", "drift_score", "drift_detected", "n_reference", "n_current"]


@query("drift_selected", v.with_views(*selected_views()) + SELECTED_OUT)
def drift_selected(spark, sf):
    found = drift.detect_drift(v.reference_features(spark, sf), v.current_features(spark, sf), FEATURES)
    return rounded(found.select(*JUDGED))


@query("drift_from_stored_reference", v.with_views(*selected_views()) + SELECTED_OUT)
def drift_from_stored_reference(spark, sf):
    """The reference's distinct values are counted once and stored; the run reads these and the current rows."""
    path = scratch_dir(spark, "reference-values")
    reference_values.store_reference_values(v.reference_features(spark, sf), FEATURES, path)
    stored = reference_values.open_reference_values(spark, path)
    found = reference_values.drift_from_stored(stored, v.current_features(spark, sf))
    return rounded(found.select(*JUDGED))


@query("drift_after_scaling", v.with_views(*selected_views(SCALED)) + SELECTED_OUT)
def drift_after_scaling(spark, sf):
    found = drift.detect_drift(v.reference_features(spark, sf), shifted(spark, sf), FEATURES)
    return rounded(found.select(*JUDGED))


@query(
    "drift_summary",
    v.with_views(*selected_views(SCALED))
    + """SELECT CAST(5 AS INTEGER) AS num_features_total, CAST(count(*) AS INTEGER) AS num_features_evaluated,
                CAST(5 - count(*) AS INTEGER) AS num_features_excluded, 'l_missing' AS excluded_features,
                CAST(count(*) FILTER (drifted) AS INTEGER) AS num_drifted_features,
                string_agg(feature, ',' ORDER BY list_position(['l_quantity', 'l_extendedprice', 'l_discount',
                  'l_tax'], feature)) FILTER (drifted) AS drifted_features,
                round(count(*) FILTER (drifted) / count(*) + 1e-9, 6) AS feature_drift_ratio,
                0.5e0 AS drift_share_threshold,
                count(*) FILTER (drifted) / count(*) >= 0.5 AS dataset_drift_detected, 'ok' AS status
         FROM v_selected""",
)
def drift_summary(spark, sf):
    """The listed feature without values is excluded, not counted as stable."""
    empty = F.lit(None).cast("double")
    reference = v.reference_features(spark, sf).withColumn("l_missing", empty)
    current = shifted(spark, sf).withColumn("l_missing", empty)
    features = [*FEATURES, "l_missing"]
    found = drift.detect_drift(reference, current, features)
    out = drift.drift_summary(found, features)
    lists = {c: F.array_join(c, ",") for c in ("excluded_features", "drifted_features")}
    return rounded(out.withColumns(lists))


P = v.PREDICTIONS_SQL


@query(
    "score_drift",
    v.with_views(
        P,
        """v_reference AS (SELECT probability FROM v_predictions WHERE "timestamp" < TIMESTAMP '2024-01-15 00:00:00')""",
        """v_current AS (SELECT probability FROM v_predictions WHERE "timestamp" >= TIMESTAMP '2024-01-15 00:00:00')""",
        melt_sql(features=["probability"]),
        CDF_SQL,
        STATS_SQL,
        SELECTED_SQL,
    )
    + SELECTED_OUT,
)
def score_drift(spark, sf):
    """Drift of the score itself: the second half of the month against the first."""
    log = v.predictions(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    before, after = log.filter(F.col("timestamp") < cut), log.filter(F.col("timestamp") >= cut)
    return rounded(drift.detect_drift(before, after, ["probability"]).select(*JUDGED))


@query(
    "drift_per_run",
    v.with_views(P, v.RUNS_SQL)
    + f"""SELECT "day", model_version, feature, {v.r6('drift_score')}, drift_score >= 0.1 AS drift_detected
          FROM v_run_js""",
)
def drift_per_run(spark, sf):
    items = v.run_items(spark, sf)
    before = items.filter(F.col("timestamp") < F.lit(v.RUN_REFERENCE_END).cast("timestamp_ntz"))
    return rounded(drift.binned_drift(before, items, v.RUN_FEATURES, ["day", "model_version"]))


SIGNAL_SQL = """v_recent AS (
  SELECT * FROM v_runs WHERE v_runs."timestamp" >= (SELECT max("timestamp") FROM v_runs) - INTERVAL 72 HOUR),
v_hits AS (
  SELECT *, feature_drift_ratio >= 0.3 AND drifted_features <> '' AS hit FROM v_recent),
v_names AS (
  SELECT model_version, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS n
  FROM (SELECT model_version, unnest(string_split(drifted_features, ',')) AS name FROM v_hits WHERE hit)
  GROUP BY model_version),
v_signal AS (
  SELECT h.model_version, count(*) AS num_reports_checked, max(feature_drift_ratio) AS drift_share,
         bool_or(hit) AS drift_detected, coalesce(max(n.names), '') AS drifted_feature_names,
         CAST(coalesce(max(n.n), 0) AS INTEGER) AS num_drifted_features,
         count(DISTINCT CASE WHEN hit THEN h."timestamp" END) AS n_drift_timestamps
  FROM v_hits h LEFT JOIN v_names n USING (model_version) GROUP BY h.model_version)"""


def run_reports(spark, sf):
    runs, newest = v.runs(spark, sf), v.newest_run(spark, sf)
    recent = runs.filter(F.col("timestamp") >= newest - F.expr("INTERVAL 72 HOUR"))
    names = F.filter(F.split("drifted_features", ","), lambda x: x != "")
    return recent.select(
        "model_version",
        F.col("timestamp").alias("report_time"),
        F.col("feature_drift_ratio").alias("score"),
        names.alias("names"),
    )


@query(
    "drift_signal",
    v.with_views(P, v.RUNS_SQL, SIGNAL_SQL)
    + f"""SELECT model_version, num_reports_checked, {v.r6('drift_share')}, drift_detected, drifted_feature_names,
                 num_drifted_features, 0.3e0 AS drift_threshold, n_drift_timestamps, 'ok' AS status FROM v_signal""",
)
def drift_signal(spark, sf):
    folded = drift.fold_signal(run_reports(spark, sf), ["model_version"])
    out = folded.withColumns(
        {
            "drifted_feature_names": F.array_join("drifted_feature_names", ","),
            "n_drift_timestamps": F.size("drift_timestamps").cast("bigint"),
        }
    ).drop("drift_timestamps")
    return rounded(out)


@query(
    "drift_recommendation",
    v.with_views(P, v.RUNS_SQL, SIGNAL_SQL)
    + f"""SELECT model_version, drift_detected AS retraining_recommended, {v.r6('drift_share')},
                 0.3e0 AS drift_threshold, CAST(72 AS INTEGER) AS lookback_hours FROM v_signal""",
)
def drift_recommendation(spark, sf):
    signal = drift.fold_signal(run_reports(spark, sf), ["model_version"])
    out = drift.recommendation(signal, 72)
    return rounded(
        out.select("model_version", "retraining_recommended", "drift_share", "drift_threshold", "lookback_hours")
    )


@query(
    "alert_levels",
    v.with_views(P, v.RUNS_SQL)
    + """SELECT "timestamp", model_version,
                CASE WHEN feature_drift_ratio > 0.5 THEN 'critical' WHEN feature_drift_ratio >= 0.3 THEN 'warning'
                     ELSE 'normal' END AS drift_level,
                CASE WHEN num_predictions / lookback_hours < 10 THEN 'critical'
                     WHEN num_predictions / lookback_hours < 50 THEN 'warning' ELSE 'normal' END AS volume_level,
                feature_drift_ratio > 0.2 AS inspect, num_drifted_features > 5 AS many_features,
                dataset_drift_detected AS log_alert
         FROM v_runs""",
)
def alert_levels(spark, sf):
    out = drift.alert_levels(v.runs(spark, sf))
    return out.select(
        "timestamp", "model_version", "drift_level", "volume_level", "inspect", "many_features", "log_alert"
    )


@query(
    "recent_drift_alerts",
    v.with_views(P, v.RUNS_SQL)
    + f"""SELECT "timestamp", model_version, {v.r6('feature_drift_ratio')}, num_drifted_features FROM v_runs
          WHERE dataset_drift_detected ORDER BY v_runs."timestamp" DESC, model_version DESC LIMIT 10""",
)
def recent_drift_alerts(spark, sf):
    out = drift.recent_drift_alerts(v.runs(spark, sf), 10, ["timestamp", "model_version"])
    return rounded(out.select("timestamp", "model_version", "feature_drift_ratio", "num_drifted_features"))


@query(
    "f1_alert_levels",
    v.with_views(v.SCORED_SQL, v.LABELS_SQL)
    + """, monthly AS (
           SELECT date_trunc('day', "timestamp") AS "day",
                  2.0 * count(*) FILTER (prediction = 1 AND true_label = 1)
                  / nullif(2 * count(*) FILTER (prediction = 1 AND true_label = 1)
                           + count(*) FILTER (prediction <> true_label), 0) AS f1_score
           FROM v_scored JOIN v_labels USING (prediction_id) GROUP BY 1),
         base AS (SELECT 2.0 * count(*) FILTER (prediction = 1 AND true_label = 1)
                  / nullif(2 * count(*) FILTER (prediction = 1 AND true_label = 1)
                           + count(*) FILTER (prediction <> true_label), 0) AS f1_base
                  FROM v_scored JOIN v_labels USING (prediction_id))
         SELECT "day", round(coalesce(f1_score, 0) + 1e-9, 6) AS f1_score,
                round((coalesce(f1_score, 0) - f1_base) / f1_base * 100 + 1e-9, 6) AS f1_change_pct,
                CASE WHEN (coalesce(f1_score, 0) - f1_base) / f1_base * 100 <= -10 THEN 'critical'
                     WHEN (coalesce(f1_score, 0) - f1_base) / f1_base * 100 <= -5 THEN 'warning'
                     ELSE 'normal' END AS f1_level
         FROM monthly CROSS JOIN base""".lstrip(),
)
def f1_alert_levels(spark, sf):
    from modelwatch.operators.evaluate import classification_metrics, f1_alerts
    from modelwatch.operators.labels import labeled_predictions

    rows = labeled_predictions(v.scored(spark, sf), v.labels(spark, sf))
    daily = classification_metrics(rows.withColumn("day", F.date_trunc("day", "timestamp")), ["day"])
    overall = classification_metrics(rows).first()["f1_score"]
    return rounded(f1_alerts(daily, F.lit(overall)).select("day", "f1_score", "f1_change_pct", "f1_level"))


@query(
    "events_props_drift",
    v.with_views(
        """v_reference AS (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events
             WHERE ts < TIMESTAMP '2024-01-15 00:00:00')""",
        """v_current AS (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events
             WHERE ts >= TIMESTAMP '2024-01-15 00:00:00')""",
        melt_sql(features=["k"]),
        CDF_SQL,
        STATS_SQL,
        SELECTED_SQL,
    )
    + SELECTED_OUT,
)
def events_props_drift(spark, sf):
    """Drift of a value held in a JSON column."""
    rows = v.table(spark, sf, "events").select("ts", F.from_json("props", "k bigint")["k"].alias("k"))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    found = drift.detect_drift(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), ["k"])
    return rounded(found.select(*JUDGED))
