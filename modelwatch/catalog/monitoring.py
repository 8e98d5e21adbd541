"""Queries over the prediction log: cleaning, time filters, label-free metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import views as v
from modelwatch.catalog.registry import query, rounded
from modelwatch.operators import cleaning, proxy, timewindows
from modelwatch.operators.registry import recent_monitoring, trend
from modelwatch.plans.retention import keep_recent

P = v.PREDICTIONS_SQL
NEWEST = '(SELECT max("timestamp") FROM v_predictions)'


def _now(df):
    return df.agg(F.max("timestamp")).scalar()


# ---- cleaning ------------------------------------------------------------------------------------------

@query(
    "canonical_log",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS prediction_id, l_shipdate AS "timestamp",
              l_returnflag AS model_version, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS prediction,
              l_quantity / 50.0 AS probability, l_shipdate AS application_date,
              l_quantity, l_extendedprice, l_discount, l_tax
       FROM lineitem""",
)
def canonical_log(spark, sf):
    rows = v.lines(spark, sf).select(
        "*",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("prediction_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("model_version"),
        F.when(F.col("l_quantity") >= 25, 1).otherwise(0).alias("prediction"),
        (F.col("l_quantity") / 50.0).alias("probability"),
    )
    return cleaning.canonical_log(rows, v.LINE_FEATURES)


@query(
    "clamp_features",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
              CAST(least(greatest(l_quantity, 10), 40) AS BIGINT) AS l_quantity,
              least(greatest(l_extendedprice, 1000.0), 50000.0) AS l_extendedprice,
              least(greatest(l_discount, 0.02), 0.08) AS l_discount,
              least(greatest(coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END, 0.0),
                    CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 0.01 END), 0.05) AS l_tax
       FROM lineitem""",
)
def clamp_features(spark, sf):
    rows = v.lines(spark, sf).withColumn(
        "l_tax", F.when(F.col("l_returnflag") == "R", F.lit("bad")).otherwise(F.col("l_tax").cast("string"))
    )
    bounds = {
        "l_quantity": (10, 40),
        "l_extendedprice": (1000.0, 50000.0),
        "l_discount": (0.02, 0.08),
        "l_tax": (0.01, 0.05),
    }
    return cleaning.clamp_table(rows, bounds, integers=["l_quantity"]).select(*v.LINE_KEY, *v.LINE_FEATURES)


@query(
    "median_impute",
    """WITH gaps AS (
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
                CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS l_quantity,
                CASE WHEN l_linestatus <> 'F' THEN l_extendedprice END AS l_extendedprice FROM lineitem),
       mids AS (SELECT median(l_quantity) AS mq, median(l_extendedprice) AS mp FROM gaps)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, coalesce(l_quantity, mq) AS l_quantity,
              round(coalesce(l_extendedprice, mp) + 1e-9, 6) AS l_extendedprice
       FROM gaps CROSS JOIN mids""",
)
def median_impute(spark, sf):
    rows = v.lines(spark, sf).select(
        *v.LINE_KEY,
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linestatus") != "F", F.col("l_extendedprice")).alias("l_extendedprice"),
    )
    return rounded(cleaning.impute_median(rows, ["l_quantity", "l_extendedprice"]))


#: Forty-eight columns: every feature times 1 to 12, with gaps in another seventh of the rows for each.
WIDE = [(f"{c}_{k}", c, k) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for k in range(1, 13)]


def _wide_sql() -> str:
    gaps = ", ".join(f"CASE WHEN (l_orderkey + {k}) % 7 <> 0 THEN {c} * {k} END AS {n}" for n, c, k in WIDE)
    mids = ", ".join(f"median({n}) AS {n}" for n, _, _ in WIDE)
    means = ", ".join(v.r6(f"avg(coalesce(g.{n}, m.{n}))", n) for n, _, _ in WIDE)
    return f"""WITH gaps AS (SELECT l_returnflag, {gaps} FROM lineitem), mids AS (SELECT {mids} FROM gaps)
               SELECT l_returnflag, {means} FROM gaps g CROSS JOIN mids m GROUP BY l_returnflag"""


@query("median_impute_wide", _wide_sql())
def median_impute_wide(spark, sf):
    """Two scans find the medians of all columns; means per return flag after filling the gaps."""
    lines = v.lines(spark, sf)
    gaps = [F.when((F.col("l_orderkey") + k) % 7 != 0, F.col(c) * k).alias(n) for n, c, k in WIDE]
    filled = cleaning.impute_median(lines.select("l_returnflag", *gaps), [n for n, _, _ in WIDE])
    return rounded(filled.groupBy("l_returnflag").agg(*[F.avg(n).alias(n) for n, _, _ in WIDE]))


@query(
    "numeric_only",
    """SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
)
def numeric_only(spark, sf):
    return cleaning.numeric_only(v.lines(spark, sf), drop=["l_orderkey"])


@query(
    "label_delay_days",
    v.with_views(v.SCORED_SQL, v.LABELS_SQL)
    + """SELECT l.prediction_id, l.true_label,
                CAST(floor(epoch_us(l.label_timestamp - s."timestamp") / 86400000000.0) AS INTEGER) AS days_delayed
         FROM v_labels l LEFT JOIN v_scored s USING (prediction_id)""",
)
def label_delay_days(spark, sf):
    from modelwatch.operators.labels import with_delay

    out = with_delay(v.labels(spark, sf), v.scored(spark, sf))
    return out.select("prediction_id", "true_label", "days_delayed")


# ---- time filters --------------------------------------------------------------------------------------

LOG_COLUMNS = ["prediction_id", "timestamp", "model_version", "prediction", "probability"]
LOG_SQL = 'SELECT prediction_id, "timestamp", model_version, prediction, round(probability + 1e-9, 6) AS probability'


@query(
    "lookback_24h",
    v.with_views(P) + f'{LOG_SQL} FROM v_predictions WHERE "timestamp" > {NEWEST} - INTERVAL 24 HOUR',
)
def lookback_24h(spark, sf):
    log = v.predictions(spark, sf)
    return rounded(timewindows.lookback(log, _now(log), 24).select(*LOG_COLUMNS))


@query(
    "recent_days",
    v.with_views(P) + f"{LOG_SQL} FROM v_predictions WHERE application_date >= TIMESTAMP '2024-01-20 12:00:00'",
)
def recent_days(spark, sf):
    log = v.predictions(spark, sf)
    return rounded(timewindows.recent_days(log, "2024-02-19 12:00:00", 30).select(*LOG_COLUMNS))


@query(
    "recent_window",
    v.with_views(P)
    + f'{LOG_SQL} FROM v_predictions WHERE "timestamp" BETWEEN {NEWEST} - INTERVAL 7 DAY AND {NEWEST}',
)
def recent_window(spark, sf):
    return rounded(timewindows.recent_window(v.predictions(spark, sf), 7).select(*LOG_COLUMNS))


@query(
    "temporal_split",
    v.with_views(P)
    + """SELECT split, count(*) AS n, min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM (
           SELECT "timestamp", CASE WHEN "timestamp" < TIMESTAMP '2024-01-20 00:00:00' THEN 'train' ELSE 'eval' END
             AS split
           FROM v_predictions
           WHERE "timestamp" < TIMESTAMP '2024-01-20 00:00:00'
              OR ("timestamp" >= TIMESTAMP '2024-01-21 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-28 00:00:00'))
         GROUP BY split""",
)
def temporal_split(spark, sf):
    split = timewindows.temporal_split(
        v.predictions(spark, sf), "2024-01-20 00:00:00", "2024-01-21 00:00:00", "2024-01-28 00:00:00"
    )
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


@query(
    "split_cut_70_30",
    v.with_views(P)
    + """, ranked AS (
           SELECT "timestamp" AS tm, row_number() OVER (ORDER BY "timestamp", prediction_id) - 1 AS rk,
                  count(*) OVER () AS n FROM v_predictions),
         cut AS (SELECT min(tm) AS train_end FROM ranked WHERE rk = CAST(floor(0.7e0 * n) AS BIGINT))
         SELECT train_end, train_end + INTERVAL 1 SECOND AS eval_start, max(tm) + INTERVAL 1 SECOND AS eval_end,
                count(*) AS n_total, count(*) FILTER (tm < train_end) AS n_train,
                count(*) FILTER (tm >= train_end AND tm < train_end + INTERVAL 1 SECOND) AS n_dropped_gap,
                count(*) FILTER (tm >= train_end + INTERVAL 1 SECOND) AS n_eval
         FROM ranked CROSS JOIN cut GROUP BY train_end""".lstrip(),
)
def split_cut_70_30(spark, sf):
    return timewindows.split_points(v.predictions(spark, sf))


@query(
    "split_dynamic_counts",
    v.with_views(P)
    + """, ranked AS (
           SELECT "timestamp" AS tm, row_number() OVER (ORDER BY "timestamp", prediction_id) - 1 AS rk,
                  count(*) OVER () AS n FROM v_predictions),
         cut AS (SELECT min(tm) AS train_end FROM ranked WHERE rk = CAST(floor(0.7e0 * n) AS BIGINT))
         SELECT CASE WHEN tm < train_end THEN 'train' ELSE 'eval' END AS split, count(*) AS n
         FROM ranked CROSS JOIN cut WHERE tm < train_end OR tm >= train_end + INTERVAL 1 SECOND
         GROUP BY 1""".lstrip(),
)
def split_dynamic_counts(spark, sf):
    split = timewindows.dynamic_split(v.predictions(spark, sf))
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "id_membership",
    v.with_views(v.SCORED_SQL, v.LABELS_SQL)
    + """SELECT prediction_id, "timestamp", prediction, round(probability + 1e-9, 6) AS probability FROM v_scored
         WHERE prediction_id IN (SELECT prediction_id FROM v_labels WHERE toxic = 1)""",
)
def id_membership(spark, sf):
    ids = v.labels(spark, sf).filter("toxic = 1")
    out = timewindows.by_ids(v.scored(spark, sf), ids)
    return rounded(out.select("prediction_id", "timestamp", "prediction", "probability"))


@query(
    "volume_24h",
    v.with_views(P) + f'SELECT count(*) AS volume FROM v_predictions WHERE "timestamp" > {NEWEST} - INTERVAL 24 HOUR',
)
def volume_24h(spark, sf):
    log = v.predictions(spark, sf)
    return timewindows.recent_volume(log, _now(log))


@query("logged_rows", "SELECT count(*) AS predictions_logged FROM events")
def logged_rows(spark, sf):
    return v.predictions(spark, sf).agg(F.count(F.lit(1)).alias("predictions_logged"))


@query(
    "sample_guard",
    v.with_views(P)
    + """SELECT count(*) AS num_predictions,
                CASE WHEN count(*) < 200 THEN 'insufficient_data' ELSE 'ok' END AS status
         FROM v_predictions WHERE "timestamp" > TIMESTAMP '2024-01-29 23:30:00'""",
)
def sample_guard(spark, sf):
    log = v.predictions(spark, sf)
    return timewindows.sample_guard(timewindows.lookback(log, "2024-01-30 23:30:00", 24))


# ---- label-free metrics --------------------------------------------------------------------------------

STATS_SQL = ", ".join(
    [
        "count(*) AS num_predictions",
        v.r6("avg(prediction)", "positive_rate"),
        v.r6("avg(probability)", "probability_mean"),
        v.r6("stddev_samp(probability)", "probability_std"),
    ]
)
QUARTILE_SQL = ", ".join(
    v.r6(f"quantile_cont(probability, {q})", n) for n, q in proxy.QUARTILES.items()
)


@query("proxy_stats", v.with_views(P) + f"SELECT {STATS_SQL}, {QUARTILE_SQL}, 'ok' AS status FROM v_predictions")
def proxy_stats(spark, sf):
    return rounded(proxy.distribution_stats(v.predictions(spark, sf)))


@query(
    "proxy_stats_by_version",
    v.with_views(P)
    + f"SELECT model_version, {STATS_SQL}, {QUARTILE_SQL}, 'ok' AS status FROM v_predictions GROUP BY model_version",
)
def proxy_stats_by_version(spark, sf):
    """Small buckets on purpose: the quartiles take the bucketed path used for large inputs."""
    return rounded(proxy.distribution_stats(v.predictions(spark, sf), ["model_version"], rows_per_bucket=700))


@query(
    "probability_entropy",
    v.with_views(P) + f"SELECT {v.r6('entropy')} FROM {v.entropy_sql('v_predictions', '')} e",
)
def probability_entropy(spark, sf):
    return rounded(proxy.probability_entropy(v.predictions(spark, sf)))


TREND_ROWS = f"""v_trend AS (
  SELECT w.window_hours, p.* FROM v_predictions p JOIN (SELECT unnest([1, 6, 24]) AS window_hours) w
    ON p."timestamp" > {NEWEST} - to_hours(w.window_hours))"""
TREND_SQL = f"""SELECT window_hours, count, positive_rate, probability_mean, probability_std, {v.r6('entropy')},
       'ok' AS status
FROM (SELECT window_hours, count(*) AS count, {v.r6('avg(prediction)', 'positive_rate')},
             {v.r6('avg(probability)', 'probability_mean')}, {v.r6('stddev_samp(probability)', 'probability_std')}
      FROM v_trend GROUP BY window_hours)
JOIN {v.entropy_sql('v_trend', 'window_hours')} e USING (window_hours)"""


@query("trailing_trends", v.with_views(P, TREND_ROWS) + TREND_SQL)
def trailing_trends(spark, sf):
    return rounded(proxy.trailing_trends(v.predictions(spark, sf)))


@query(
    "proxy_report",
    v.with_views(P, TREND_ROWS, f"trends AS ({TREND_SQL})")
    + f"""SELECT 'window_' || CAST(window_hours AS VARCHAR) || 'H' AS scope, count, positive_rate, probability_mean,
                 probability_std, entropy FROM trends
          UNION ALL
          SELECT 'overall' AS scope, count(*) AS count, {v.r6('avg(prediction)', 'positive_rate')},
                 {v.r6('avg(probability)', 'probability_mean')},
                 {v.r6('stddev_samp(probability)', 'probability_std')},
                 (SELECT {v.r6('entropy')} FROM {v.entropy_sql('v_predictions', '')} e) AS entropy
          FROM v_predictions""",
)
def proxy_report(spark, sf):
    return rounded(proxy.proxy_report(v.predictions(spark, sf)))


@query(
    "rate_of_change",
    v.with_views(P, v.RUNS_SQL)
    + """, paired AS (
           SELECT model_version, "timestamp", positive_rate, probability_mean,
                  lag(positive_rate) OVER w AS pr, lag(probability_mean) OVER w AS pm,
                  epoch_us("timestamp" - lag("timestamp") OVER w) / 3600000000.0 AS h
           FROM v_runs WINDOW w AS (PARTITION BY model_version ORDER BY "timestamp"))
         SELECT model_version, "timestamp",
                round(CASE WHEN h > 0 THEN (positive_rate - pr) / h WHEN h <= 0 THEN 0.0 END + 1e-9, 6)
                  AS positive_rate_change_per_hour,
                round(CASE WHEN h > 0 THEN (probability_mean - pm) / h WHEN h <= 0 THEN 0.0 END + 1e-9, 6)
                  AS probability_mean_change_per_hour,
                h AS time_delta_hours, CASE WHEN h IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status
         FROM paired""".lstrip(),
)
def rate_of_change(spark, sf):
    return rounded(proxy.rate_of_change(v.runs(spark, sf)))


@query(
    "last_100_stats",
    v.with_views(P)
    + f"""SELECT {STATS_SQL} FROM (
            SELECT * FROM v_predictions ORDER BY "timestamp" DESC, prediction_id DESC LIMIT 100)""",
)
def last_100_stats(spark, sf):
    return rounded(proxy.last_n_stats(v.predictions(spark, sf), 100))


@query(
    "hourly_resample",
    v.with_views(P)
    + """, hourly AS (SELECT date_trunc('hour', "timestamp") AS "hour", sum(prediction) AS s, avg(probability) AS m
                      FROM v_predictions GROUP BY 1)
         SELECT c."hour", CAST(coalesce(s, 0) AS BIGINT) AS positives, round(m + 1e-9, 6) AS probability_mean
         FROM (SELECT unnest(generate_series((SELECT min("hour") FROM hourly), (SELECT max("hour") FROM hourly),
                                             INTERVAL 1 HOUR)) AS "hour") c LEFT JOIN hourly h ON h."hour" = c."hour"
      """.lstrip(),
)
def hourly_resample(spark, sf):
    return rounded(proxy.hourly_resample(v.predictions(spark, sf)))


@query(
    "class_balance",
    "SELECT quality, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels) + 1e-9, 6) AS share FROM labels GROUP BY 1",
)
def class_balance(spark, sf):
    return rounded(proxy.class_balance(v.table(spark, sf, "labels"), "quality"))


# ---- the run table -------------------------------------------------------------------------------------

RUNS_OUT = f"""SELECT "timestamp", model_version, lookback_hours, num_predictions, {v.r6('positive_rate')},
  {v.r6('probability_mean')}, {v.r6('probability_std')}, {v.r6('entropy')}, dataset_drift_detected,
  {v.r6('feature_drift_ratio')}, num_drifted_features, drifted_features FROM v_runs"""


@query("monitoring_runs", v.with_views(P, v.RUNS_SQL) + RUNS_OUT)
def monitoring_runs(spark, sf):
    return rounded(v.runs(spark, sf))


@query(
    "recent_monitoring",
    v.with_views(P, v.RUNS_SQL)
    + f"""SELECT "timestamp", model_version, num_predictions, {v.r6('feature_drift_ratio')}, dataset_drift_detected,
                 {v.r6('positive_rate')}, {v.r6('entropy')}
          FROM v_runs ORDER BY v_runs."timestamp" DESC, model_version LIMIT 50""",
)
def recent_monitoring_query(spark, sf):
    return rounded(recent_monitoring(v.runs(spark, sf), 50))


@query(
    "drift_trend",
    v.with_views(P, v.RUNS_SQL)
    + f"""SELECT "timestamp", model_version, {v.r6('feature_drift_ratio')}, dataset_drift_detected,
                 num_drifted_features
          FROM v_runs WHERE v_runs."timestamp" > (SELECT max("timestamp") FROM v_runs) - INTERVAL 7 DAY""",
)
def drift_trend(spark, sf):
    return rounded(trend(v.runs(spark, sf), v.newest_run(spark, sf), 7, order=["timestamp", "model_version"]))


@query(
    "retention_90d",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY""",
)
def retention_90d(spark, sf):
    orders = v.table(spark, sf, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    return keep_recent(orders, newest, 90, "o_orderdate").select("o_orderkey", "o_orderdate")
