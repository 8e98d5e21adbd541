"""Retraining need, promotion gates, model versions and decision reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.catalog import evaluating as ev
from modelwatch.catalog import views as v
from modelwatch.catalog.drifting import SIGNAL_SQL, run_reports
from modelwatch.catalog.registry import query, rounded
from modelwatch.operators import drift, evaluate, gates, labels, registry
from modelwatch.plans import rounds
from modelwatch.session import scratch_dir
from modelwatch.sources import commits

D, VER, P = v.DECISIONS_SQL, v.VERSIONS_SQL, v.PREDICTIONS_SQL
AT = "2002-01-01 00:00:00"
AT_SQL = f"TIMESTAMP '{AT}'"


# ---- need ----------------------------------------------------------------------------------------------

@query(
    "retrain_need",
    v.with_views(P, v.RUNS_SQL, SIGNAL_SQL)
    + f""", coverage AS (
           SELECT model_version, count(*) AS total_predictions, count(l.doc_id) AS labeled_predictions,
                  count(l.doc_id) / count(*) AS coverage_rate
           FROM v_predictions p LEFT JOIN labels l ON CAST(l.doc_id * 2 AS VARCHAR) = p.prediction_id
           GROUP BY model_version)
         SELECT model_version, total_predictions, labeled_predictions, {v.r6('coverage_rate')},
                CASE WHEN labeled_predictions >= 60 AND coverage_rate >= 0.03 THEN 'train' ELSE 'skip' END AS action,
                'scheduled' AS trigger_reason,
                CASE WHEN labeled_predictions >= 60 AND coverage_rate >= 0.03 THEN 'enough labels to train'
                     ELSE 'too few labels' END AS reason,
                {v.r6('drift_share')}, num_drifted_features, drift_share > 0 AS drift_seen,
                CASE WHEN drift_share > 0 THEN printf('drift in the data set: share %.3f, %d features', drift_share, num_drifted_features)
                  ELSE 'no drift seen' END AS drift_interpretation
         FROM coverage JOIN v_signal USING (model_version)""",
)
def retrain_need(spark, sf):
    log = v.predictions(spark, sf)
    known = v.table(spark, sf, "labels").select((F.col("doc_id") * 2).cast("string").alias("prediction_id"))
    coverage = labels.label_coverage(log, known, ["model_version"]).drop("unlabeled_predictions")
    signal = drift.fold_signal(run_reports(spark, sf), ["model_version"])
    context = coverage.join(
        signal.select("model_version", "drift_share", "num_drifted_features"), "model_version"
    )
    return rounded(gates.drift_interpretation(gates.retraining_need(context, 60, 0.03)))


# ---- gates ---------------------------------------------------------------------------------------------

def candidates(spark, sf):
    """One promotion candidate per decision of the order table, with its model's promotion history."""
    rows = gates.promotion_before(v.decisions(spark, sf))
    n = F.col("id")
    return rows.select(
        "id",
        "model_name",
        "timestamp",
        "last_promotion",
        (n % 900).alias("num_samples"),
        F.when(n % 17 != 0, (n % 100) / 100.0).alias("coverage_rate"),
        F.when(n % 19 != 0, (n % 13 - 3) / 2.0).alias("f1_improvement_pct"),
        F.when(n % 23 != 0, (n % 31 - 15) / 500.0).alias("brier_change"),
        F.when(n % 7 == 0, F.array(F.lit("lang=de: F1 dropped 9.1%"))).otherwise(
            F.array().cast("array<string>")
        ).alias("segment_issues"),
    )


CANDIDATES_SQL = """v_candidates AS (
  SELECT id, model_name, "timestamp",
         max(CASE WHEN action = 'promote' THEN "timestamp" END) OVER (
           PARTITION BY model_name ORDER BY "timestamp", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS last_promotion,
         id % 900 AS num_samples, CASE WHEN id % 17 <> 0 THEN (id % 100) / 100.0e0 END AS coverage_rate,
         CASE WHEN id % 19 <> 0 THEN (id % 13 - 3) / 2.0e0 END AS f1_improvement_pct,
         CASE WHEN id % 23 <> 0 THEN (id % 31 - 15) / 500.0e0 END AS brier_change,
         id % 7 = 0 AS has_issue
  FROM v_decisions)"""

JUDGED_SQL = """v_cool AS (
  SELECT *, CAST(floor(epoch_us("timestamp" - last_promotion) / 86400000000.0) AS INTEGER) AS days_since_promotion
  FROM v_candidates),
v_judged AS (
  SELECT *, num_samples >= 200 AS g0, coalesce(coverage_rate * 100 >= 30, FALSE) AS g1,
         last_promotion IS NULL OR days_since_promotion >= 7 AS g2,
         coalesce(f1_improvement_pct >= 2, FALSE) AS g3, coalesce(brier_change <= 0.01e0, FALSE) AS g4,
         NOT has_issue AS g5
  FROM v_cool),
v_first AS (
  SELECT *, CASE WHEN NOT g0 THEN 0 WHEN NOT g1 THEN 1 WHEN NOT g2 THEN 2 WHEN NOT g3 THEN 3 WHEN NOT g4 THEN 4
                 WHEN NOT g5 THEN 5 ELSE 6 END AS first_failed
  FROM v_judged)"""
GATE_VIEWS = (D, CANDIDATES_SQL, JUDGED_SQL)


def _single_gate(index: int, condition: str) -> str:
    return v.with_views(*GATE_VIEWS) + f"SELECT id, {condition} AS passed FROM v_judged"


def _gate_rows(spark, sf, index):
    """One gate judged alone for every candidate."""
    judged = gates._judge(gates.GateLimits())[index][1]
    return gates.cooldown(candidates(spark, sf)).select("id", judged.alias("passed"))


for _i, _name in enumerate(["samples", "coverage", "cooldown", "improvement", "calibration", "segments"]):
    query(f"gate_{_name}", _single_gate(_i, f"g{_i}"))(lambda spark, sf, i=_i: _gate_rows(spark, sf, i))


@query(
    "gate_decision",
    v.with_views(*GATE_VIEWS)
    + """SELECT id, model_name, "timestamp", CASE WHEN first_failed = 6 THEN 'promote' ELSE 'reject' END AS action,
                ['sufficient_samples', 'minimum_coverage', 'promotion_cooldown', 'metric_improvement',
                 'calibration_maintained', 'no_segment_regression', NULL][first_failed + 1] AS failed_gate,
                ['insufficient_samples', 'insufficient_coverage', 'promotion_cooldown', 'insufficient_improvement',
                 'calibration_degraded', 'segment_regression', NULL][first_failed + 1] AS reason_code,
                CASE first_failed
                  WHEN 0 THEN printf('Insufficient samples: %d < 200', num_samples)
                  WHEN 1 THEN 'label coverage too low: '
                    || coalesce(CAST(id % 100 AS VARCHAR) || '.0%', 'missing') || ' < 30.0%'
                  WHEN 2 THEN printf('promoted %d days ago; %d days of cooldown left',
                                     days_since_promotion, 7 - days_since_promotion)
                  WHEN 3 THEN 'F1 gain too small: '
                    || coalesce(printf('%.2f%%', f1_improvement_pct), 'missing') || ' < 2.0%'
                  WHEN 4 THEN 'calibration got worse, Brier by '
                    || coalesce(printf('%.4f', brier_change), 'missing') || ' > 0.01'
                  WHEN 5 THEN 'segments got worse: lang=de: F1 dropped 9.1%'
                  ELSE printf('passed every gate: F1 by %.2f%%, Brier by %+.4f, all segments hold',
                              f1_improvement_pct, brier_change) END AS reason
         FROM v_first""".replace(
        "coalesce(CAST(id % 100 AS VARCHAR) || '.0%', 'missing')",
        "CASE WHEN coverage_rate IS NULL THEN 'missing' ELSE CAST(id % 100 AS VARCHAR) || '.0%' END",
    ),
)
def gate_decision(spark, sf):
    out = gates.gate_decision(candidates(spark, sf))
    return out.select("id", "model_name", "timestamp", "action", "failed_gate", "reason_code", "reason")


@query(
    "gate_results",
    v.with_views(*GATE_VIEWS)
    + """SELECT id, CAST(position AS INTEGER) AS position, gate, position <= first_failed AS evaluated,
                CASE WHEN position <= first_failed THEN passed END AS passed
         FROM (SELECT id, first_failed,
                      unnest([0, 1, 2, 3, 4, 5]) AS position,
                      unnest(['sufficient_samples', 'minimum_coverage', 'promotion_cooldown', 'metric_improvement',
                              'calibration_maintained', 'no_segment_regression']) AS gate,
                      unnest([g0, g1, g2, g3, g4, g5]) AS passed
               FROM v_first)""",
)
def gate_results(spark, sf):
    return gates.gate_rows(gates.gate_decision(candidates(spark, sf)), ["id"])


@query(
    "cooldown",
    v.with_views(D)
    + f"""SELECT model_name, max("timestamp") AS last_promotion,
                 CAST(floor(epoch_us({AT_SQL} - max("timestamp")) / 86400000000.0) AS INTEGER) AS days_since_promotion,
                 floor(epoch_us({AT_SQL} - max("timestamp")) / 86400000000.0) >= 160 AS cooldown_passed
          FROM v_decisions WHERE action = 'promote' AND "timestamp" <= {AT_SQL} GROUP BY model_name""",
)
def cooldown(spark, sf):
    now = F.lit(AT).cast("timestamp_ntz")
    last = gates.last_promotion(v.decisions(spark, sf), now).withColumn("timestamp", now)
    out = gates.cooldown(last, 160)
    return out.select("model_name", "last_promotion", "days_since_promotion", "cooldown_passed")


@query(
    "segment_regression",
    v.with_views(*ev.SEGMENT_VIEWS)
    + f"""SELECT p.segment_feature, p.segment, {v.r6('p.f1_score', 'prod_f1')}, {v.r6('s.f1_score', 'shadow_f1')},
                 round(CASE WHEN p.f1_score > 0 THEN (s.f1_score - p.f1_score) / p.f1_score * 100 END + 1e-9, 6)
                   AS change_pct,
                 s.f1_score IS NULL AS missing_in_shadow,
                 coalesce(p.f1_score > 0 AND (s.f1_score - p.f1_score) / p.f1_score * 100 < -5, FALSE) AS regressed
          FROM (SELECT * FROM v_metrics WHERE model = 'production' AND num_samples >= 30) p
          LEFT JOIN (SELECT * FROM v_metrics WHERE model = 'shadow' AND num_samples >= 30) s
            ON p.segment_feature = s.segment_feature AND p.segment = s.segment""",
)
def segment_regression(spark, sf):
    found = evaluate.segment_metrics(v.evaluated(spark, sf), ["lang", "source"], ["model"])
    return rounded(gates.segment_regression(found))


#: Segments of at least 30 rows whose F1 the challenger loses by more than five per cent.
REGRESSED_SQL = v.with_views(ev.SEGMENT_ROWS, *ev.full_views("v_segments", ev.SEGMENT_BY)) + """
  SELECT p.segment FROM (SELECT * FROM v_metrics WHERE model = 'production' AND num_samples >= 30) p
  JOIN (SELECT * FROM v_metrics WHERE model = 'shadow' AND num_samples >= 30) s
    ON p.segment_feature = s.segment_feature AND p.segment = s.segment
  WHERE p.f1_score > 0 AND (s.f1_score - p.f1_score) / p.f1_score * 100 < -5"""


def replay_candidate(spark, sf):
    """What the gates judge of two replayed models; the cooldown counts from the newest promotion of any model."""
    now = F.lit(AT).cast("timestamp_ntz")
    rows = v.evaluated(spark, sf)
    metrics = evaluate.evaluate(rows, ["model"])
    coverage = labels.label_coverage(v.scored(spark, sf), v.labels(spark, sf)).select("coverage_rate").scalar()
    promoted = gates.last_promotion(v.decisions(spark, sf), now, by=()).select("last_promotion").scalar()
    compared = gates.segment_regression(evaluate.segment_metrics(rows, ["lang", "source"], ["model"]))
    issues = gates.segment_issues(compared, []).select("segment_issues").scalar()
    return evaluate.compare_models(metrics).select(
        F.col("shadow_num_samples").alias("num_samples"),
        coverage.alias("coverage_rate"),
        "f1_improvement_pct",
        "brier_change",
        promoted.alias("last_promotion"),
        now.alias("timestamp"),
        issues.alias("segment_issues"),
    )


@query(
    "replay_gate",
    v.with_views(D, *ev.MODEL_VIEWS, ev.COMPARISON_SQL)
    + f"""SELECT shadow_num_samples AS num_samples, {v.r6('f1_improvement_pct')}, {v.r6('brier_change')},
                 CASE WHEN shadow_num_samples < 200 THEN 'sufficient_samples'
                      WHEN (SELECT count(*) FROM v_labels) / (SELECT count(*) FROM v_scored) * 100 < 30
                        THEN 'minimum_coverage'
                      WHEN (SELECT max("timestamp") FROM v_decisions WHERE action = 'promote' AND "timestamp" <= {AT_SQL})
                           > {AT_SQL} - INTERVAL 7 DAY THEN 'promotion_cooldown'
                      WHEN f1_improvement_pct < 2 THEN 'metric_improvement'
                      WHEN brier_change > 0.01 THEN 'calibration_maintained'
                      WHEN EXISTS (FROM ({REGRESSED_SQL})) THEN 'no_segment_regression' END AS failed_gate
          FROM v_comparison""",
)
def replay_gate(spark, sf):
    """From labeled rows of two models to a decision: metrics, comparison, coverage, last promotion, segments, gates."""
    decided = gates.gate_decision(replay_candidate(spark, sf))
    return rounded(decided.select("num_samples", "f1_improvement_pct", "brier_change", "failed_gate"))


@query(
    "first_deploy",
    v.with_views(D, VER)
    + """SELECT c_custkey, m.model_name, m.production_version, m.production_version IS NULL AS is_first_deployment,
                CASE WHEN m.production_version IS NULL THEN 'promote' END AS first_action,
                CASE WHEN m.production_version IS NULL THEN 'no model in production yet' END
                  AS first_reason
         FROM (SELECT c_custkey, 'model_' || CAST(c_custkey % 25 AS VARCHAR) AS model_name, production_version
               FROM customer LEFT JOIN (
                 SELECT model_name, max(version) AS production_version FROM v_versions WHERE stage = 'Production'
                 GROUP BY model_name) p ON p.model_name = 'model_' || CAST(c_custkey % 25 AS VARCHAR)) m""",
)
def first_deploy(spark, sf):
    model_name = F.concat(F.lit("model_"), (F.col("c_custkey") % 25).cast("string"))
    rows = v.table(spark, sf, "customer").select("c_custkey", model_name.alias("model_name"))
    return gates.first_deployment(rows, v.versions(spark, sf))


# ---- versions ------------------------------------------------------------------------------------------

STATE_OUT = "SELECT model_name, version, stage, promoted_at, archived_at FROM"
STATE = ["model_name", "version", "stage", "promoted_at", "archived_at"]
TARGET_SQL = """v_targets AS (
  SELECT model_name, CAST(max(version) - 2 AS INTEGER) AS version FROM v_versions GROUP BY model_name)"""


def _targets(spark, sf, back=2):
    return v.versions(spark, sf).groupBy("model_name").agg((F.max("version") - back).cast("int").alias("version"))


PROMOTE_SQL = (
    v.with_views(D, VER, TARGET_SQL)
    + f"""SELECT m.model_name, m.version,
                 CASE WHEN m.version = t.version THEN 'Production' WHEN stage = 'Production' THEN 'Archived'
                      ELSE stage END AS stage,
                 CASE WHEN m.version = t.version THEN {AT_SQL} ELSE promoted_at END AS promoted_at,
                 CASE WHEN m.version = t.version THEN NULL WHEN stage = 'Production' THEN {AT_SQL}
                      ELSE archived_at END AS archived_at
          FROM v_versions m JOIN v_targets t USING (model_name)"""
)


@query("promote_state", PROMOTE_SQL)
def promote_state(spark, sf):
    return registry.promote(v.versions(spark, sf), _targets(spark, sf), AT).select(*STATE)


@query("rollback_state", PROMOTE_SQL)
def rollback_state(spark, sf):
    """Restoring an archived version is the same change of state as promoting it."""
    return registry.rollback(v.versions(spark, sf), _targets(spark, sf), AT).select(*STATE)


@query(
    "reject_state",
    v.with_views(D, VER)
    + f"""SELECT model_name, version, 'Archived' AS stage, promoted_at,
                 CASE WHEN stage = 'Production' THEN {AT_SQL} ELSE archived_at END AS archived_at
          FROM v_versions""",
)
def reject_state(spark, sf):
    versions = v.versions(spark, sf)
    return registry.reject(versions, versions.filter("stage = 'Production'"), AT).select(*STATE)


@query(
    "promotion_records",
    v.with_views(D, VER, TARGET_SQL)
    + f"""SELECT {AT_SQL} AS "timestamp", 'promote' AS action, t.model_name, t.version,
                 c.version AS previous_production_version
          FROM v_targets t JOIN v_versions c ON c.model_name = t.model_name AND c.stage = 'Production'
          UNION ALL
          SELECT {AT_SQL}, 'promote_failed', 'model_unknown', 1, NULL""",
)
def promotion_records(spark, sf):
    versions, targets = v.versions(spark, sf), _targets(spark, sf)
    unknown = targets.agg(F.lit("model_unknown").alias("model_name"), F.lit(1).alias("version"))
    out = registry.transition_records(versions, targets.unionByName(unknown), AT, "promote")
    return out.select("timestamp", "action", "model_name", "version", "previous_production_version")


@query(
    "stage_latest",
    v.with_views(D, VER)
    + f"""SELECT model_name, stage, max(version) AS version, {v.r6('max_by(f1_score, version)', 'f1_score')}
          FROM v_versions GROUP BY model_name, stage""",
)
def stage_latest(spark, sf):
    out = registry.latest_per_stage(v.versions(spark, sf))
    return rounded(out.select("model_name", "stage", "version", "f1_score"))


@query(
    "rollback_candidates",
    v.with_views(D, VER) + "SELECT model_name, version, archived_at FROM v_versions WHERE stage = 'Archived'",
)
def rollback_candidates(spark, sf):
    return registry.rollback_candidates(v.versions(spark, sf)).select("model_name", "version", "archived_at")


@query(
    "version_upsert",
    v.with_views(D, VER)
    + f"""SELECT model_name, version, CASE WHEN f1_score >= 0.6 THEN 'Archived' ELSE stage END AS stage, trained_at,
                 promoted_at, CASE WHEN f1_score >= 0.6 THEN {AT_SQL} ELSE archived_at END AS archived_at,
                 {v.r6('f1_score')}, CASE WHEN f1_score >= 0.6 THEN {AT_SQL} ELSE updated_at END AS updated_at
          FROM v_versions
          UNION ALL
          SELECT model_name, CAST(-version AS INTEGER), 'Archived', {AT_SQL}, NULL, {AT_SQL}, 0.5e0, {AT_SQL}
          FROM v_versions""",
)
def version_upsert(spark, sf):
    """Updates of known versions change stage and times only; unknown versions are inserted whole."""
    versions = v.versions(spark, sf)
    moment = F.lit(AT).cast("timestamp_ntz")
    changed = {
        "stage": F.lit("Archived"),
        "promoted_at": F.lit(None).cast("timestamp_ntz"),
        "trained_at": moment,
        "archived_at": moment,
        "updated_at": moment,
        "f1_score": F.lit(0.5),
    }
    known = versions.filter("f1_score >= 0.6").withColumns(changed)
    new = versions.withColumns(changed).withColumn("version", (-F.col("version")).cast("int"))
    out = registry.upsert_versions(versions, known.unionByName(new))
    columns = ["model_name", "version", "stage", "trained_at", "promoted_at", "archived_at", "f1_score", "updated_at"]
    return rounded(out.select(*columns))


ROUND_SQL = """v_round AS (
  SELECT model_name, CAST(max(version) + 1 AS INTEGER) AS version,
         CASE CAST(substr(model_name, 7) AS INTEGER) % 3 WHEN 0 THEN 'promote' WHEN 1 THEN 'reject' ELSE 'skip' END AS action
  FROM v_versions GROUP BY model_name),
v_drift AS (SELECT model_name, avg(feature_drift_ratio) AS feature_drift_ratio FROM v_decisions GROUP BY model_name)"""


@query(
    "round_state",
    v.with_views(D, VER, ROUND_SQL)
    + f"""SELECT s.*, CASE WHEN s.version = r.version THEN r.action END AS decided,
                 CASE WHEN s.version = r.version THEN {v.r6('d.feature_drift_ratio', 'x').replace(' AS x', '')} END AS drift_at_decision
          FROM (
            SELECT m.model_name, m.version,
                   CASE WHEN r.action = 'promote' AND stage = 'Production' THEN 'Archived' ELSE stage END AS stage, promoted_at,
                   CASE WHEN r.action = 'promote' AND stage = 'Production' THEN {AT_SQL} ELSE archived_at END AS archived_at
            FROM v_versions m JOIN v_round r USING (model_name)
            UNION ALL
            SELECT model_name, version, CASE action WHEN 'promote' THEN 'Production' ELSE 'Archived' END,
                   CASE action WHEN 'promote' THEN {AT_SQL} END, CASE action WHEN 'reject' THEN {AT_SQL} END
            FROM v_round WHERE action <> 'skip') s
          JOIN v_round r USING (model_name) JOIN v_drift d USING (model_name)""",
)
def round_state(spark, sf):
    """One round over all models: challengers promoted, rejected or skipped; version table, decisions and records in one commit.
    A second round that was decided on the state before it is turned away."""
    root = scratch_dir(spark, "rounds")
    start = rounds.publish_round(spark, root, commits.latest(spark, root), v.versions(spark, sf))
    number = F.col("model_name").substr(7, 9).cast("int") % 3
    newest = rounds.read_round(spark, root)["versions"].groupBy("model_name").agg((F.max("version") + 1).cast("int").alias("version"))
    context = v.decisions(spark, sf).groupBy("model_name").agg(F.avg("feature_drift_ratio").alias("feature_drift_ratio"))
    action = F.when(number == 0, "promote").when(number == 1, "reject").otherwise("skip")
    decision = newest.withColumns({"action": action, "timestamp": F.lit(AT).cast("timestamp_ntz")}).join(context, "model_name")
    decision = decision.withColumnRenamed("version", "shadow_model_version")
    challengers = newest.withColumns({"stage": F.lit("Staging"), "trained_at": F.lit(AT).cast("timestamp_ntz")})
    rounds.finish_round(spark, root, start, decision, challengers, AT)
    try:
        rounds.finish_round(spark, root, start, decision.withColumn("action", F.lit("promote")), challengers, AT)
        raise AssertionError("a stale round was published")
    except commits.StaleVersion:
        state = rounds.read_round(spark, root)
    made = state["decisions"].select(
        "model_name", F.col("shadow_model_version").alias("version"), F.col("action").alias("decided"),
        F.col("feature_drift_ratio").alias("drift_at_decision"),
    )
    return rounded(state["versions"].select(*STATE).join(made, ["model_name", "version"], "left"))


@query(
    "model_timeline",
    v.with_views(D, VER)
    + f"""SELECT m.model_name, m.version, m.stage, m.trained_at, m.promoted_at, {v.r6('m.f1_score', 'f1_score')},
                 {v.r6('d.feature_drift_ratio', 'drift_at_training')}, d.action
          FROM v_versions m LEFT JOIN v_decisions d ON m.decision_id = d.id""",
)
def model_timeline(spark, sf):
    return rounded(registry.model_timeline(v.versions(spark, sf), v.decisions(spark, sf)))


@query(
    "production_at",
    v.with_views(D, VER)
    + """SELECT d.id, d.model_name, d."timestamp", arg_max(m.version, m.version) AS production_version
         FROM v_decisions d LEFT JOIN v_versions m ON m.model_name = d.model_name AND m.promoted_at <= d."timestamp"
         GROUP BY ALL""",
)
def production_at(spark, sf):
    rows = v.decisions(spark, sf).select("id", "model_name", "timestamp")
    return registry.production_at(rows, v.versions(spark, sf))


# ---- decision reports ----------------------------------------------------------------------------------

HISTORY = [
    "id", "timestamp", "action", "trigger_reason", "feature_drift_ratio", "labeled_samples", "coverage_pct", "failed_gate",
]


@query(
    "decision_history",
    v.with_views(D)
    + f"""SELECT id, "timestamp", action, trigger_reason, {v.r6('feature_drift_ratio')}, labeled_samples,
                 {v.r6('coverage_pct')}, failed_gate
          FROM v_decisions ORDER BY v_decisions."timestamp" DESC, id DESC LIMIT 50""",
)
def decision_history(spark, sf):
    return rounded(registry.decision_history(v.decisions(spark, sf).select(*HISTORY)))


@query("count_by_action", v.with_views(D) + "SELECT action, count(*) AS n FROM v_decisions GROUP BY action")
def count_by_action(spark, sf):
    return registry.count_by_action(v.decisions(spark, sf))


@query(
    "rejection_rate",
    v.with_views(D)
    + """SELECT model_name, count(*) FILTER (action = 'reject') AS rejected,
                count(*) FILTER (action = 'promote') AS promoted,
                round(count(*) FILTER (action = 'reject') / count(*) FILTER (action IN ('reject', 'promote')) + 1e-9, 6)
                  AS rejection_rate
         FROM v_decisions GROUP BY model_name""",
)
def rejection_rate(spark, sf):
    return rounded(registry.rejection_rate(v.decisions(spark, sf), ["model_name"]))
