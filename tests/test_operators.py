"""Gates, registry, contracts, fingerprints, cleaning, splits, labels and perturbations on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import cleaning, evaluate, fingerprint, gates, labels, perturb, registry, timewindows, validate
from modelwatch.tables import FEATURES, PREDICTION_LOG, REAL_FEATURES

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def log(spark):
    """300 hourly scored rows with ten features."""
    rng = np.random.default_rng(42)
    n = 300
    pdf = pd.DataFrame(
        {
            "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
            "prediction_id": [f"pred_{i}" for i in range(n)],
            "prediction": rng.binomial(1, 0.1, n),
            "probability": rng.beta(2, 8, n),
            "model_version": "1",
        }
    )
    for f in FEATURES:
        pdf[f] = rng.uniform(0, 2, n) if f in REAL_FEATURES else rng.integers(0, 5, n)
    pdf["age"] = rng.integers(18, 80, n)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def label_table(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "prediction_id": [f"pred_{i}" for i in range(200)],
                "true_label": rng.binomial(1, 0.1, 200),
                "label_timestamp": pd.date_range("2024-01-02", periods=200, freq="h"),
                "label_source": "test",
                "days_delayed": rng.integers(1, 30, 200),
                "updated_at": pd.date_range("2024-01-02", periods=200, freq="h"),
            }
        )
    )


def candidate(spark, **changes):
    row = {
        "num_samples": 250,
        "coverage_rate": 0.5,
        "f1_improvement_pct": 5.0,
        "brier_change": -0.005,
        "last_promotion": None,
        "timestamp": NOW,
        "segment_issues": [],
        **changes,
    }
    schema = (
        "num_samples long, coverage_rate double, f1_improvement_pct double, brier_change double, "
        "last_promotion timestamp, timestamp timestamp, segment_issues array<string>"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    "changes,limits,action,failed",
    [
        ({}, {}, "promote", None),
        ({"coverage_rate": None}, {"min_coverage_pct": 0.0}, "promote", None),
        ({"f1_improvement_pct": 0.625, "brier_change": 0.0}, {}, "reject", "metric_improvement"),
        ({"f1_improvement_pct": 6.25, "brier_change": 0.05}, {}, "reject", "calibration_maintained"),
        ({"num_samples": 150}, {}, "reject", "sufficient_samples"),
        ({"f1_improvement_pct": 3.75, "coverage_rate": None}, {"min_f1_improvement_pct": 5.0}, "reject", "minimum_coverage"),
        ({"coverage_rate": 0.29}, {}, "reject", "minimum_coverage"),
        ({"brier_change": None}, {}, "reject", "calibration_maintained"),
        ({"last_promotion": NOW - dt.timedelta(days=6, hours=23)}, {}, "reject", "promotion_cooldown"),
        ({"last_promotion": NOW - dt.timedelta(days=7)}, {}, "promote", None),
        ({"segment_issues": ["lang=de: F1 dropped 9.0%"]}, {}, "reject", "no_segment_regression"),
        ({"num_samples": 10, "brier_change": 0.5}, {}, "reject", "sufficient_samples"),
    ],
)
def test_gate_table(spark, changes, limits, action, failed):
    row = gates.gate_decision(candidate(spark, **changes), gates.GateLimits(**limits)).first()
    assert (row["action"], row["failed_gate"]) == (action, failed)
    seen = [g["gate"] for g in row["gate_results"] if g["evaluated"]]
    assert seen[-1] == (failed or gates.GATES[-1])


def test_custom_gate(spark):
    limits = gates.GateLimits(extra={"even_samples": F.col("num_samples") % 2 == 1})
    row = gates.gate_decision(candidate(spark), limits).first()
    assert (row["action"], row["failed_gate"]) == ("reject", "even_samples")


def test_missing_segments_are_listed_but_do_not_block(spark):
    rows = [("production", "f", "a", 0.8), ("production", "f", "b", 0.5), ("shadow", "f", "a", 0.7), ("production", "f", "z", 0.0)]
    found = gates.segment_regression(spark.createDataFrame(rows, "model string, segment_feature string, segment string, f1_score double"))
    issues = gates.segment_issues(found, []).first()
    assert issues["segment_issues"] == ["f=a: F1 dropped 12.5%"]
    assert issues["missing_segments"] == ["f=b", "f=z"]


def versions(spark):
    rows = [("m", 1, "Archived"), ("m", 2, "Production"), ("m", 3, "Staging"), ("n", 1, "Production")]
    df = spark.createDataFrame(rows, "model_name string, version int, stage string")
    for c in ("promoted_at", "archived_at", "updated_at"):
        df = df.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    return df


def stages(df):
    return {(r["model_name"], r["version"]): r["stage"] for r in df.collect()}


def test_promote_reject_rollback(spark):
    before = versions(spark)
    target = spark.createDataFrame([("m", 3)], "model_name string, version int")
    promoted = registry.promote(before, target, NOW)
    assert stages(promoted) == {("m", 1): "Archived", ("m", 2): "Archived", ("m", 3): "Production", ("n", 1): "Production"}
    assert validate.one_production_per_model(promoted).first()["violations"] == 0
    assert stages(registry.reject(before, target, NOW))[("m", 3)] == "Archived"
    back = registry.rollback(promoted, spark.createDataFrame([("m", 1)], "model_name string, version int"), NOW)
    assert stages(back)[("m", 1)] == "Production" and stages(back)[("m", 3)] == "Archived"


def test_records_of_success_rejection_and_failure(spark):
    targets = spark.createDataFrame([("m", 3), ("x", 9)], "model_name string, version int")
    rows = {r["model_name"]: r for r in registry.transition_records(versions(spark), targets, NOW, "promote").collect()}
    assert rows["m"]["action"] == "promote" and rows["m"]["previous_production_version"] == 2
    assert rows["x"]["action"] == "promote_failed" and rows["x"]["error"]
    rejected = registry.transition_records(versions(spark), targets.filter("model_name = 'm'"), NOW, "reject").first()
    assert rejected["outcome"] == "successful_rejection"


def test_retraining_need(spark):
    rows = spark.createDataFrame([(200, 0.2), (199, 0.9), (500, 0.19)], "labeled_predictions long, coverage_rate double")
    assert [r["action"] for r in gates.retraining_need(rows).collect()] == ["train", "skip", "skip"]


def contract(df):
    report = validate.contract_report(df, validate.prediction_rules(), [["prediction_id"]])
    return {r["rule"]: r["violations"] for r in report.collect() if r["violations"]}


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"prediction": "2"}, "prediction in (0, 1)"),
        ({"probability": "1.5D"}, "probability in [0, 1]"),
        ({"age": "-5"}, "age in [18, 120]"),
        ({"MonthlyIncome": "double('NaN')"}, "MonthlyIncome >= 0"),
        ({"model_version": "string(NULL)"}, "model_version not null"),
        ({"prediction_id": "'same'"}, "unique (prediction_id)"),
    ],
)
def test_contract_finds_corruption(log, change, rule):
    assert contract(log) == {}
    assert rule in contract(log.withColumns({c: F.expr(e) for c, e in change.items()}))


def test_missing_column_and_wrong_type_are_schema_issues(log):
    whole = log.withColumn("application_date", F.col("timestamp"))
    assert validate.schema_issues(whole, PREDICTION_LOG) == []
    assert "missing column age" in validate.schema_issues(whole.drop("age"), PREDICTION_LOG)
    assert validate.schema_issues(whole.withColumn("age", F.lit("old")), PREDICTION_LOG)
    with pytest.raises(ValueError, match="age"):
        validate.require_columns(log.drop("age"), FEATURES)


def test_fingerprint_ignores_order_and_sees_changes(log):
    base = fingerprint.fingerprint(log).first()["dataset_hash"]
    mixed = log.select(*reversed(log.columns)).repartition(5)
    assert fingerprint.fingerprint(mixed).first()["dataset_hash"] == base
    assert fingerprint.fingerprint(log.unionByName(log.limit(1))).first()["dataset_hash"] != base
    changed = log.withColumn("age", F.when(F.col("prediction_id") == "pred_7", 99).otherwise(F.col("age")))
    with pytest.raises(ValueError):
        fingerprint.verify(changed, base)
    fast = fingerprint.fingerprint(log, portable=False).first()["dataset_hash"]
    assert fingerprint.matches(mixed, fast, portable=False)


def test_profile(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    row = fingerprint.profile(rows).first().asDict()
    assert row == {"dataset_rows": 3, "dataset_columns": 2, "missing_cells": 2, "duplicate_rows": 1}


def test_clamp(spark):
    rows = spark.createDataFrame([("7.9",), ("-3",), ("bad",), ("NaN",), ("Infinity",), (None,), ("99",)], "v string")
    got = [r[0] for r in rows.select(cleaning.clamp("v", 0, 10, default=5, to="bigint")).collect()]
    assert got == [7, 0, 5, 5, 5, 5, 10]


def test_names_and_projection(spark):
    rows = spark.createDataFrame([(1, 2)], "`NumberOfTime30-59DaysPastDueNotWorse` int, age int")
    fixed = cleaning.normalise_names(rows, ["NumberOfTime30_59DaysPastDueNotWorse", "age"])
    assert fixed.columns == ["NumberOfTime30_59DaysPastDueNotWorse", "age"]
    with pytest.raises(ValueError):
        cleaning.normalise_names(rows)
    with pytest.raises(ValueError):
        cleaning.project_features(rows, ["DebtRatio"])


def test_median_imputation_paths_agree(spark):
    rng = np.random.default_rng(2)
    values = [None if i % 7 == 0 else float(x) for i, x in enumerate(rng.normal(size=500))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    want = float(np.median([v for v in values if v is not None]))
    for options in ({}, {"accuracy": 20, "most_rows": 40}):
        out = cleaning.impute_median(rows, ["v"], **options).filter("i = 0").first()["v"]
        assert out == pytest.approx(want)


def test_canonical_log_defaults(log):
    rows = cleaning.canonical_log(log.drop("prediction_id"), FEATURES)
    first = rows.first()
    assert first["application_date"] == first["timestamp"]
    assert rows.select("prediction_id").distinct().count() == 300
    with pytest.raises(ValueError):
        cleaning.canonical_log(log.drop("age"), FEATURES)


def test_temporal_leak_and_empty_windows(log):
    rows = log.withColumn("application_date", F.col("timestamp"))
    with pytest.raises(ValueError, match="leak"):
        timewindows.temporal_split(rows, "2024-01-05 00:00:00", "2024-01-04 00:00:00", "2024-01-09 00:00:00")
    split = timewindows.temporal_split(rows, "2024-01-05 00:00:00", "2030-01-01 00:00:00", "2030-02-01 00:00:00")
    with pytest.raises(ValueError, match="eval"):
        timewindows.require_both_splits(split)


@pytest.mark.parametrize("size", [None, 40])
def test_split_points(log, size):
    row = timewindows.split_points(log, date="timestamp", rows_per_bucket=size).first()
    assert row["train_end"] == dt.datetime(2024, 1, 1) + dt.timedelta(hours=210)
    assert (row["n_train"], row["n_dropped_gap"], row["n_eval"]) == (210, 1, 89)


def test_split_is_disjoint(log):
    split = timewindows.dynamic_split(log, date="timestamp")
    parts = [split.filter(f"split = '{s}'") for s in ("train", "eval")]
    assert labels.shared_ids(*parts).first()["n_common"] == 0


def test_labels(log, label_table):
    joined = labels.labeled_predictions(log, label_table)
    assert joined.count() == 200
    twice = label_table.unionByName(
        label_table.withColumns({"true_label": 1 - F.col("true_label"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")})
    )
    again = labels.labeled_predictions(log, twice)
    assert again.count() == 200
    assert again.agg(F.sum("true_label")).first()[0] == 200 - joined.agg(F.sum("true_label")).first()[0]
    assert labels.label_conflicts(twice).count() == 200
    cover = labels.label_coverage(log, twice).first()
    assert cover["coverage_rate"] == pytest.approx(200 / 300) and cover["unlabeled_predictions"] == 100
    assert labels.label_coverage(log.limit(0), label_table).first()["coverage_rate"] == 0.0
    assert labels.label_orphans(log.filter("prediction_id <> 'pred_0'"), label_table).count() == 1


@pytest.mark.parametrize("size", [None, 30])
def test_label_history_in_buckets(label_table, size):
    hot = label_table.withColumn("prediction_id", F.lit("one"))
    seen = labels.label_history(hot, rows_per_bucket=size).orderBy("updated_at").collect()
    for before, after in zip(seen, seen[1:]):
        assert after["previous_label"] == before["true_label"]


@pytest.mark.parametrize("size", [None, 30])
def test_resample_ratio_is_exact(spark, size):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "id int, y int")
    out = perturb.resample_ratio(rows, "y", 0.25, ["id"], rows_per_bucket=size)
    assert out.count() == 400
    assert out.agg(F.sum("y")).first()[0] == 100


def test_flip_rate_noise_moments_and_times(spark):
    rows = spark.range(20000).withColumns({"y": F.lit(0), "x": F.lit(0.0)})
    flipped = perturb.flip_labels(rows, "y", 0.1, ["id"]).agg(F.avg("y")).first()[0]
    assert flipped == pytest.approx(0.1, abs=0.01)
    noisy = perturb.add_noise(rows, "x", 3.0, ["id"]).agg(F.avg("x"), F.stddev("x")).first()
    assert noisy[0] == pytest.approx(0.0, abs=0.1) and noisy[1] == pytest.approx(3.0, abs=0.1)
    timed = perturb.assign_times(rows, "2020-01-01 00:00:00", "2021-01-01 00:00:00", ["id"])
    low, high = timed.agg(F.min("application_date"), F.max("application_date")).first()
    assert low >= dt.datetime(2020, 1, 1) and high < dt.datetime(2021, 1, 1)


def test_sample_paths_agree(spark):
    rows = spark.range(30000).withColumnRenamed("id", "k")
    drawn = rows.withColumn("_u", perturb.hash_bits(42, "k"))
    large = perturb._large_sample(drawn, ["k"], 9000).drop("_u", "_slot")
    small = perturb.seeded_sample(rows, ["k"], 9000)
    assert large.count() == 9000
    assert large.exceptAll(small).count() == 0


def test_eval_validity(spark):
    rows = spark.createDataFrame([(1,)] * 40, "true_label int")
    assert evaluate.eval_validity(rows).first()["issues"] == ["eval_single_class"]
    assert evaluate.eval_validity(rows.limit(0)).first()["issues"] == ["no_labeled_data"]
