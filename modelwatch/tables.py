"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

# The ten monitored features in their stored order.
FEATURES = [
    "RevolvingUtilizationOfUnsecuredLines",
    "age",
    "NumberOfTime30_59DaysPastDueNotWorse",
    "DebtRatio",
    "MonthlyIncome",
    "NumberOfOpenCreditLinesAndLoans",
    "NumberOfTimes90DaysLate",
    "NumberRealEstateLoansOrLines",
    "NumberOfTime60_89DaysPastDueNotWorse",
    "NumberOfDependents",
]
REAL_FEATURES = {"RevolvingUtilizationOfUnsecuredLines", "DebtRatio", "MonthlyIncome"}
TARGET = "SeriousDlqin2yrs"


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FEATURE_SCHEMA = T.StructType(
    [T.StructField(f, T.DoubleType() if f in REAL_FEATURES else T.LongType()) for f in FEATURES]
)

PREDICTION_KEYS = _schema(
    prediction_id=T.StringType(),
    timestamp=T.TimestampType(),
    model_version=T.StringType(),
    prediction=T.IntegerType(),
    probability=T.DoubleType(),
    application_date=T.TimestampType(),
)
PREDICTION_LOG = T.StructType(PREDICTION_KEYS.fields + FEATURE_SCHEMA.fields)

LABEL_STORE = _schema(
    prediction_id=T.StringType(),
    true_label=T.IntegerType(),
    label_timestamp=T.TimestampType(),
    label_source=T.StringType(),
    days_delayed=T.IntegerType(),
    updated_at=T.TimestampType(),
)

REFERENCE_METADATA = _schema(
    created_at=T.StringType(),
    source=T.StringType(),
    num_samples=T.LongType(),
    num_features=T.IntegerType(),
    reference_hash=T.StringType(),
    purpose=T.StringType(),
    mutation_policy=T.StringType(),
    features=T.ArrayType(T.StringType()),
)

FEATURE_DRIFT = _schema(
    feature=T.StringType(),
    drift_detected=T.BooleanType(),
    stat_test=T.StringType(),
    p_value=T.DoubleType(),
    threshold=T.DoubleType(),
    drift_score=T.DoubleType(),
)

DRIFT_SUMMARY = _schema(
    timestamp=T.StringType(),
    reference_metadata=REFERENCE_METADATA,
    dataset_drift_detected=T.BooleanType(),
    drift_share=T.DoubleType(),
    feature_drift_ratio=T.DoubleType(),
    num_drifted_features=T.IntegerType(),
    num_features_total=T.IntegerType(),
    num_features_evaluated=T.IntegerType(),
    num_features_excluded=T.IntegerType(),
    excluded_features=T.ArrayType(T.StringType()),
    features=T.ArrayType(FEATURE_DRIFT),
    feature_drift_details=T.ArrayType(FEATURE_DRIFT),
    drifted_features=T.ArrayType(T.StringType()),
)

MONITORING_METRICS = _schema(
    id=T.StringType(),
    timestamp=T.TimestampType(),
    lookback_hours=T.IntegerType(),
    num_predictions=T.LongType(),
    positive_rate=T.DoubleType(),
    probability_mean=T.DoubleType(),
    probability_std=T.DoubleType(),
    entropy=T.DoubleType(),
    dataset_drift_detected=T.BooleanType(),
    feature_drift_ratio=T.DoubleType(),
    num_drifted_features=T.IntegerType(),
    drift_summary_ref=T.StringType(),
    created_at=T.TimestampType(),
)

RETRAINING_DECISIONS = _schema(
    id=T.StringType(),
    timestamp=T.TimestampType(),
    trigger_reason=T.StringType(),
    feature_drift_ratio=T.DoubleType(),
    num_drifted_features=T.IntegerType(),
    dataset_drift_detected=T.BooleanType(),
    drifted_features=T.ArrayType(T.StringType()),
    labeled_samples=T.LongType(),
    coverage_pct=T.DoubleType(),
    action=T.StringType(),
    failed_gate=T.StringType(),
    reason=T.StringType(),
    shadow_model_version=T.IntegerType(),
    production_model_version=T.IntegerType(),
    f1_improvement_pct=T.DoubleType(),
    brier_change=T.DoubleType(),
    drift_summary_ref=T.StringType(),
    evaluation_report_ref=T.StringType(),
    created_at=T.TimestampType(),
)

MODEL_VERSIONS = _schema(
    model_name=T.StringType(),
    version=T.IntegerType(),
    stage=T.StringType(),
    trained_at=T.TimestampType(),
    promoted_at=T.TimestampType(),
    archived_at=T.TimestampType(),
    trigger_reason=T.StringType(),
    training_run_id=T.StringType(),
    f1_score=T.DoubleType(),
    brier_score=T.DoubleType(),
    num_samples=T.LongType(),
    feature_drift_ratio_at_training=T.DoubleType(),
    decision_id=T.StringType(),
    created_at=T.TimestampType(),
    updated_at=T.TimestampType(),
)

DECISION_RECORD = _schema(
    timestamp=T.StringType(),
    action=T.StringType(),
    shadow_run_id=T.StringType(),
    shadow_version=T.StringType(),
    previous_production_version=T.StringType(),
    promoted_by=T.StringType(),
    rejected_by=T.StringType(),
    outcome=T.StringType(),
    restored_version=T.StringType(),
    rolled_back_from=T.StringType(),
    error=T.StringType(),
    evaluation_decision=T.StringType(),
)

PERTURBATION_EVENT = _schema(
    timestamp=T.StringType(),
    drift_type=T.StringType(),
    affected_features=T.ArrayType(T.StringType()),
    magnitude=T.DoubleType(),
    reason=T.StringType(),
    metadata=T.MapType(T.StringType(), T.StringType()),
)
PERTURBATION_LOG = _schema(drift_events=T.ArrayType(PERTURBATION_EVENT))

# Allowed words of the audit tables.
TRIGGER_REASONS = ["scheduled", "manual", "drift_alert"]
ACTIONS = ["train", "skip", "promote", "reject"]
STAGES = ["Staging", "Production", "Archived", "None"]
