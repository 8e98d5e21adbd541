"""One retraining round: coverage, split, challenger, replay on identical rows, gates, decision."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.times import instant
from modelwatch.operators import evaluate, gates, labels, model, timewindows
from modelwatch.operators.gates import GateLimits


#: What a decision keeps of the drift it was made under.
DRIFT_CONTEXT = {
    "feature_drift_ratio": "double",
    "num_drifted_features": "int",
    "dataset_drift_detected": "boolean",
    "drifted_features": "array<string>",
    "drift_summary_ref": "string",
    "evaluation_report_ref": "string",
}


def retraining_round(
    log: DataFrame,
    label_table: DataFrame,
    features: Sequence[str],
    now: str | datetime,
    production: PipelineModel | None,
    decisions: DataFrame | None = None,
    segments: Sequence[str] = (),
    limits: GateLimits | None = None,
    model_name: str = "model",
    min_eval_rows: int = timewindows.MIN_EVAL_ROWS,
    trigger: str = "scheduled",
    drift: DataFrame | None = None,
    challenger_version: int | None = None,
    production_version: int | None = None,
    **forest,
) -> dict[str, DataFrame | PipelineModel | None]:
    """Decide whether a newly trained challenger replaces the production model.

    Returns ``decision`` (one row for the decision table), and where the round got that far ``metrics``,
    ``segments``, ``comparison`` and the fitted ``challenger``, and always ``duplicates``: how many repeated predictions
    the training rows left out. ``drift`` is one row of drift context (columns of ``DRIFT_CONTEXT``) that the decision keeps.
    Only counts, cut points and the decision reach the driver.
    """
    limits = limits or GateLimits()
    known = {"shadow_model_version": challenger_version, "production_model_version": production_version}
    context = {c: drift.select(c).scalar() for c in DRIFT_CONTEXT if drift is not None and c in drift.columns}
    duplicates = labels.duplicate_count(log, ["prediction_id"])

    def decided_as(row: DataFrame, **more) -> dict[str, DataFrame | PipelineModel | None]:
        row = row.withColumns({**context, **{c: F.lit(x).cast("int") for c, x in known.items()}})
        return {"decision": _decision(row, model_name, now), "duplicates": duplicates, **more}

    recent = timewindows.recent_days(log, now, 30)
    coverage = labels.label_coverage(recent, label_table)
    need = gates.retraining_need(coverage, trigger=trigger)
    if need.first()["action"] == "skip":
        return decided_as(need, challenger=None)

    joined = labels.training_rows(log, label_table)
    points = timewindows.split_points(log).first()
    split = timewindows.temporal_split(joined, points["train_end"], points["eval_start"], points["eval_end"])
    train, held_out = split.filter("split = 'train'"), split.filter("split = 'eval'")
    challenger, _ = model.train_challenger(train, held_out, features, **forest)
    if challenger is None:
        row = need.withColumns({"action": F.lit("reject"), "reason": F.lit("invalid evaluation set")})
        return decided_as(row, challenger=None)
    if production is None:
        row = need.withColumns(
            {"action": F.lit("promote"), "reason": F.lit("no model in production yet")}
        )
        return decided_as(row, challenger=challenger)
    if held_out.count() < min_eval_rows:
        raise ValueError("insufficient evaluation rows")

    scored = model.replay(held_out, {"production": production, "shadow": challenger}, features)
    metrics = evaluate.evaluate(scored, ["model"])
    comparison = evaluate.compare_models(metrics)
    issues = F.array().cast("array<string>")
    found = None
    if segments:
        per_segment = evaluate.segment_metrics(scored, segments, ["model"])
        found = gates.segment_regression(per_segment, max_drop_pct=limits.max_segment_regression_pct)
        issues = F.coalesce(gates.segment_issues(found, []).select("segment_issues").scalar(), issues)
    last = F.lit(None).cast("timestamp_ntz")
    if decisions is not None:
        last = decisions.filter((F.col("action") == "promote") & (F.col("timestamp") <= instant(now))).agg(
            F.max("timestamp")
        ).scalar()
    candidate = comparison.select(
        F.col("shadow_num_samples").alias("num_samples"),
        coverage.select("coverage_rate").scalar().alias("coverage_rate"),
        coverage.select("labeled_predictions").scalar().alias("labeled_predictions"),
        "f1_improvement_pct",
        "brier_change",
        last.alias("last_promotion"),
        instant(now).alias("timestamp"),
        issues.alias("segment_issues"),
        F.lit(trigger).alias("trigger_reason"),
    )
    decided = gates.gate_decision(candidate, limits)
    return decided_as(
        decided, metrics=metrics, comparison=comparison, segments=found, gates=gates.gate_rows(decided, ["timestamp"]), challenger=challenger
    )


def _decision(row: DataFrame, model_name: str, now: str | datetime) -> DataFrame:
    """A decision-table row; columns that do not apply are NULL, counts and coverage are always filled."""
    optional = {
        "failed_gate": "string",
        "f1_improvement_pct": "double",
        "brier_change": "double",
        "shadow_model_version": "int",
        "production_model_version": "int",
        **DRIFT_CONTEXT,
    }
    columns = [
        F.sha2(F.concat_ws("|", F.lit(model_name), instant(now).cast("string")), 256).alias("id"),
        F.lit(model_name).alias("model_name"),
        instant(now).alias("timestamp"),
        "trigger_reason",
        "action",
        "reason",
        F.col("labeled_predictions").alias("labeled_samples"),
        (F.col("coverage_rate") * 100.0).alias("coverage_pct"),
    ]
    for name, kind in optional.items():
        columns.append(F.col(name).cast(kind).alias(name) if name in row.columns else F.lit(None).cast(kind).alias(name))
    return row.select(*columns)
