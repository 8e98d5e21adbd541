"""Readers, writers, streaming over several batches, and the whole jobs."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import drift, evaluate, model
from modelwatch.operators.proxy import summary
from modelwatch.plans.monitoring import monitoring_run
from modelwatch.plans.retraining import retraining_round
from modelwatch.sources import readers, writers
from modelwatch.streaming import jobs, monitor
from modelwatch.tables import FEATURES, LABEL_STORE, PREDICTION_LOG, REAL_FEATURES

X = ["x1", "x2", "x3"]


def features_frame(n, seed=42):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({f: rng.uniform(0, 2, n) if f in REAL_FEATURES else rng.integers(0, 9, n) for f in FEATURES})
    return pdf


def test_log_roundtrip_and_reference(spark, tmp_path):
    pdf = features_frame(50)
    pdf["timestamp"] = pd.date_range("2024-01-01", periods=50, freq="h")
    pdf["model_version"], pdf["prediction"], pdf["probability"] = "1", 0, 0.25
    rows = spark.createDataFrame(pdf)
    writers.append_predictions(rows, f"{tmp_path}/log", FEATURES)
    stored = readers.read_predictions(spark, f"{tmp_path}/log")
    assert stored.count() == 50 and set(PREDICTION_LOG.names) <= set(stored.columns)

    writers.write_reference(rows.select(*FEATURES), f"{tmp_path}/ref", "2024-02-01T00:00:00")
    reference, meta = readers.read_reference(spark, f"{tmp_path}/ref", check=True)
    assert reference.count() == meta.first()["num_samples"] == 50
    with pytest.raises(Exception):
        writers.write_reference(rows.select(*FEATURES), f"{tmp_path}/ref", "2024-02-01T00:00:00")
    with pytest.raises(FileNotFoundError):
        readers.read_reference(spark, f"{tmp_path}/nothing")
    # One more row in the frozen table is noticed.
    rows.select(*FEATURES).limit(1).write.mode("append").parquet(f"{tmp_path}/ref/reference_data")
    with pytest.raises(ValueError, match="integrity"):
        readers.read_reference(spark, f"{tmp_path}/ref", check=True)


def test_malformed_csv_is_quarantined(spark, tmp_path):
    names = PREDICTION_LOG.names
    good = ["id1", "2024-01-01 00:00:00", "1", "0", "0.2", "2024-01-01 00:00:00"] + ["1"] * 10
    glued = [n for n in names if n != "application_date"] + good[:-1]
    lines = [",".join(glued), ",".join(good), ",".join(good).replace("id1", "id2"), "broken,line"]
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "predictions.csv").write_text("\n".join(lines) + "\n")
    rows = readers.read_predictions(spark, str(folder), form="csv").cache()
    fine, bad = readers.split_corrupt(rows)
    assert sorted(r["prediction_id"] for r in fine.collect()) == ["id1", "id2"]
    assert [r["line"] for r in bad.collect()] == ["broken,line"]
    wrong = readers.header_issues(spark, str(folder)).collect()
    assert len(wrong) == 1 and wrong[0]["header"] == lines[0]
    (folder / "predictions.csv").write_text(",".join(names) + "\n" + ",".join(good) + "\n")
    assert readers.header_issues(spark, str(folder)).count() == 0


def report(share, ratio, features=(), details=(), names=()):
    entry = lambda f, d: {"feature": f, "drift_detected": d}
    doc = {"drift_share": share, "feature_drift_ratio": ratio}
    if features:
        doc["features"] = [entry(*f) for f in features]
    if details:
        doc["feature_drift_details"] = [entry(*f) for f in details]
    if names:
        doc["drifted_features"] = list(names)
    return doc


def test_summaries_in_three_layouts(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    docs = {
        "drift_summary_20240301_100000.json": report(0.5, 0.4, features=[("age", True), ("debt", False)]),
        "drift_summary_20240301_090000.json": report(0.5, 0.6, details=[("income", True)]),
        "drift_summary_20240301_080000.json": report(0.5, 0.35, names=["lines"]),
        "drift_summary_20240301_070000.json": report(0.5, 0.1, features=[("late", True)]),
        "drift_summary_20240101_000000.json": report(0.5, 0.9, names=["old"]),
    }
    for name, doc in docs.items():
        (folder / name).write_text(json.dumps(doc, indent=2))
    (folder / "drift_summary_20240301_110000.json").write_text("{ not json")
    (folder / "drift_summary_garbage.json").write_text("{}")
    found = readers.read_summaries(spark, str(folder), "2024-03-01 12:00:00", 24)
    assert found.first()["report_time"] == dt.datetime(2024, 3, 1, 10)
    signal = drift.fold_signal(drift.parse_summaries(found)).first()
    assert signal["num_reports_checked"] == 4
    assert signal["drifted_feature_names"] == ["age", "income", "lines"]
    assert signal["drift_share"] == pytest.approx(0.6) and signal["drift_detected"]
    legacy = drift.fold_signal(drift.parse_summaries(found, legacy_share=True)).first()
    assert "late" in legacy["drifted_feature_names"]
    none = readers.read_summaries(spark, str(folder), "2030-01-01 00:00:00", 24)
    assert drift.fold_signal(drift.parse_summaries(none)).first()["status"] == "no_recent_reports"
    assert readers.read_summaries(spark, f"{tmp_path}/missing") is None


def test_summary_roundtrip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame(pd.DataFrame({"x1": rng.normal(size=1500), "x2": rng.normal(size=1500)}))
    judged = drift.detect_drift(a, a.withColumn("x1", F.col("x1") + 3), ["x1", "x2"])
    doc = drift.summary_document(judged, drift.drift_summary(judged, ["x1", "x2"]))
    writers.write_summary(doc, f"{tmp_path}/reports", "20240301_100000")
    parsed = drift.parse_summaries(readers.read_summaries(spark, f"{tmp_path}/reports")).first()
    assert parsed["names"] == ["x1"] and parsed["score"] == 0.5


def test_records_and_perturbation_log(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"2024-01-{d:02d}T00:00:00", "promote" if d % 2 else "reject") for d in range(1, 15)], "timestamp string, action string"
    )
    writers.write_records(rows.repartition(14), f"{tmp_path}/decisions")
    history = readers.deployment_history(readers.read_decision_records(spark, f"{tmp_path}/decisions"), 10)
    assert [r["at"].day for r in history.collect()] == list(range(14, 4, -1))
    log = {"drift_events": [
        {"timestamp": f"2024-01-0{d}T00:00:00", "drift_type": "noise", "affected_features": ["age"], "magnitude": 1.5,
         "reason": "r", "metadata": {"noise_std": 0.5}} for d in (1, 2, 3)]}
    (tmp_path / "log.json").write_text(json.dumps(log, indent=2))
    events = readers.read_perturbations(spark, f"{tmp_path}/log.json", documents=True)
    assert events.count() == 3
    writers.write_records(events.drop("at"), f"{tmp_path}/events")
    assert readers.read_perturbations(spark, f"{tmp_path}/events").count() == 3
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "decision_1.json").write_text(json.dumps({"timestamp": "2024-01-05T00:00:00", "action": "rollback"}, indent=2))
    assert readers.read_decision_records(spark, f"{tmp_path}/one", documents=True).first()["action"] == "rollback"
    assert readers.recent_perturbations(events, "2024-01-03 00:00:00", 24).count() == 2


def test_training_csv_and_sql(spark, tmp_path):
    header = ",SeriousDlqin2yrs,age,NumberOfTime30-59DaysPastDueNotWorse,MonthlyIncome"
    (tmp_path / "train.csv").write_text(header + "\n1,0,45,2,9120\n2,1,40,0,NA\n")
    rows = readers.read_training_csv(spark, f"{tmp_path}/train.csv")
    assert rows.filter("MonthlyIncome IS NULL").count() == 1
    out = readers.run_sql(spark, "SELECT * FROM train_rows WHERE age > :low", {"train_rows": rows}, low=42)
    assert out.count() == 1


def test_run_rows_are_appended_once(spark, tmp_path):
    runs = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1), (dt.datetime(2024, 1, 2), 2)], "timestamp timestamp, n int")
    writers.append_new(runs, None, f"{tmp_path}/runs")
    writers.append_new(runs, spark.read.parquet(f"{tmp_path}/runs"), f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


def test_second_production_version_stops_the_snapshot(spark, tmp_path):
    schema = "model_name string, version int, stage string, promoted_at timestamp, archived_at timestamp, updated_at timestamp"
    now = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame([("m", 1, "Production", now, None, now)], schema)
    updates = spark.createDataFrame([("m", 2, "Production", now, None, now)], schema)
    with pytest.raises(ValueError, match="one production"):
        writers.publish_versions(current, updates, f"{tmp_path}/versions")
    fixed = updates.unionByName(spark.createDataFrame([("m", 1, "Archived", None, now, now)], schema))
    writers.publish_versions(current, fixed, f"{tmp_path}/versions")
    assert spark.read.parquet(f"{tmp_path}/versions").count() == 2


# ---- streams over several micro-batches ---------------------------------------------------------------

@pytest.fixture(scope="module")
def stream_folder(spark, tmp_path_factory):
    """Three days of scored rows in six files, with copies of earlier rows in each later file."""
    folder = tmp_path_factory.mktemp("stream")
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame(
        {
            "prediction_id": [f"p{i}" for i in range(n)],
            "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.uniform(0, 72 * 3600, n)), unit="s"),
            "model_version": rng.choice(["a", "b"], n),
            "prediction": rng.integers(0, 2, n),
            "probability": rng.uniform(0, 1, n),
        }
    )
    pdf["timestamp"] = pdf["timestamp"].astype("datetime64[us]")
    for i, part in enumerate(np.array_split(np.arange(n), 6)):
        copies = pdf.iloc[part[0] - 20 : part[0]] if i else pdf.iloc[:0]
        spark.createDataFrame(pd.concat([pdf.iloc[part], copies])).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), pdf


def stream(spark, folder):
    return jobs.file_stream(spark, folder, spark.read.parquet(folder).schema, max_files=1)


def test_dedup_then_sink(spark, stream_folder, tmp_path):
    folder, pdf = stream_folder
    # Files arrive in the order of their writing; copies are a few minutes late.
    unique = monitor.deduplicated(stream(spark, folder), "3 days")
    jobs.drain(jobs.append_to(unique, f"{tmp_path}/out", f"{tmp_path}/cp"))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("prediction_id").distinct().count() == len(pdf)


def test_panes_equal_batch(spark, stream_folder, tmp_path):
    folder, pdf = stream_folder
    once = stream(spark, folder)
    jobs.drain(jobs.append_to(monitor.panes(once, "5 minutes", "3 days"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    # With a delay as long as the data no pane is closed before the end, and nothing is dropped as late.
    closed = spark.read.parquet(f"{tmp_path}/out") if any(tmp_path.glob("out/*.parquet")) else None
    batch = spark.read.parquet(folder)
    panes = monitor.panes(batch, "5 minutes", "3 days")
    merged = monitor.merge_panes(panes, ["model_version"]).orderBy("model_version").collect()
    plain = summary(batch, ["model_version"]).orderBy("model_version").collect()
    for got, want in zip(merged, plain):
        for c in ("num_predictions", "positive_rate", "probability_mean", "probability_std", "entropy"):
            assert got[c] == pytest.approx(want[c], rel=1e-9)
    assert closed is None or closed.count() <= panes.count()


def test_lookback_at_every_pane_equals_filter(spark, stream_folder):
    folder, _ = stream_folder
    batch = spark.read.parquet(folder)
    panes = monitor.panes(batch, "5 minutes", "1 hour")
    lookback = monitor.lookback_from_panes(panes)
    assert "Generate" not in lookback._jdf.queryExecution().executedPlan().toString()
    got = {(r["model_version"], r["window_end"]): r for r in lookback.collect()}
    ends = [tuple(r) for r in panes.select("model_version", "end").collect()]
    assert sorted(got) == sorted(ends)  # one row per pane
    for version, end in random.Random(5).sample(ends, 6) + [max(ends, key=lambda e: e[1])]:
        inside = (F.col("timestamp") >= F.lit(end) - F.expr("INTERVAL 24 HOUR")) & (F.col("timestamp") < F.lit(end))
        want = summary(batch.filter(inside & (F.col("model_version") == version)), ["model_version"]).first()
        for c in ("num_predictions", "positive_rate", "probability_mean", "probability_std", "entropy"):
            assert got[version, end][c] == (pytest.approx(want[c]) if want[c] is not None else None)


def test_latest_labels_over_batches(spark, tmp_path):
    schema = LABEL_STORE
    for i in range(4):
        rows = [(f"p{k}", (k + i) % 2, None, "s", None, dt.datetime(2024, 1, 1 + i)) for k in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = jobs.file_stream(spark, f"{tmp_path}/in", schema, max_files=1)
    jobs.drain(monitor.latest_labels(source, f"{tmp_path}/log", f"{tmp_path}/cp"))
    from modelwatch.operators.labels import keep_last

    log = jobs.read_sink(spark, f"{tmp_path}/log", schema)
    assert log.count() == 40
    latest = keep_last(log, ["prediction_id"], ["updated_at"]).collect()
    assert all(r["updated_at"].day == 4 and r["true_label"] == (int(r["prediction_id"][1:]) + 3) % 2 for r in latest)


def test_alerts_keep_state_between_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for i in range(6):
        rows = [(m, start + dt.timedelta(hours=10 * i)) for m in ("a", "b")]
        spark.createDataFrame(rows, "model_version string, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, max_files=1)
    jobs.drain(jobs.append_to(monitor.alerts_with_cooldown(source, 24), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = sorted((r["model_version"], r["alert_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(m, start + dt.timedelta(hours=h)) for m in ("a", "b") for h in (0, 30)]


# ---- whole jobs ----------------------------------------------------------------------------------------

def scored_log(spark, n=1200, shift=0.0):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=n) > 0).astype(int)
    pdf = pd.DataFrame(x + shift, columns=X)
    pdf["prediction_id"] = [f"p{i}" for i in range(n)]
    pdf["timestamp"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="m")).astype("datetime64[us]")
    pdf["application_date"] = pdf["timestamp"]
    pdf["model_version"], pdf["segment"] = "1", np.where(np.arange(n) % 2, "odd", "even")
    pdf["probability"] = 1 / (1 + np.exp(-x[:, 2]))
    pdf["prediction"] = (pdf["probability"] >= 0.5).astype(int)
    labels = pd.DataFrame({"prediction_id": pdf["prediction_id"], "true_label": y, "days_delayed": 1, "updated_at": pdf["timestamp"]})
    return spark.createDataFrame(pdf), spark.createDataFrame(labels)


def test_monitoring_run(spark):
    log, _ = scored_log(spark)
    moved, _ = scored_log(spark, shift=2.0)
    out = monitoring_run(moved, log, X, "2024-01-02 00:00:00", 24)
    run = out["run"].first()
    assert run["status"] == "ok" and run["dataset_drift_detected"] and run["num_drifted_features"] == 3
    assert out["document"].first()["features"][0]["stat_test"] == "Wasserstein distance (normed)"
    quiet = monitoring_run(log, log, X, "2030-01-01 00:00:00", 24)["run"].first()
    assert quiet["status"] == "insufficient_data" and quiet["positive_rate"] is None


def test_retraining_round(spark):
    log, label_table = scored_log(spark)
    joined = log.join(label_table.select("prediction_id", "true_label"), "prediction_id")
    weak = model.fit_forest(joined, ["x3"], num_trees=3, max_depth=2)
    out = retraining_round(
        log, label_table, X, "2024-01-20 00:00:00", weak, segments=["segment"], num_trees=10, max_depth=4
    )
    decision = out["decision"].first()
    assert decision["action"] == "promote" and decision["labeled_samples"] == 1200
    assert out["gates"].count() == 6
    again = retraining_round(
        log, label_table, X, "2024-01-20 00:00:00", out["challenger"], segments=["segment"], num_trees=10, max_depth=4
    )["decision"].first()
    assert again["action"] == "reject" and again["failed_gate"] == "metric_improvement"
    first = retraining_round(log, label_table, X, "2024-01-20 00:00:00", None, num_trees=3, max_depth=2)
    assert first["decision"].first()["reason"].startswith("no model in production")
    few = retraining_round(log, label_table.limit(50), X, "2024-01-20 00:00:00", None)["decision"].first()
    assert few["action"] == "skip" and few["reason"] == "too few labels"


def test_python_model_scoring(spark):
    log, label_table = scored_log(spark, 300)
    out = model.score_with_python(log, lambda frame: 1 / (1 + np.exp(-frame["x1"])), X)
    rows = out.join(label_table.select("prediction_id", "true_label"), "prediction_id")
    assert evaluate.roc_auc(rows).first()["roc_auc"] > 0.8


def test_custom_drift_test(spark):
    a, _ = scored_log(spark, 300)
    values = drift.value_table(a, a, X, {})

    def fn(frame):
        return pd.DataFrame({"feature": [frame["feature"].iloc[0]], "n": [int(frame["n_ref"].sum())]})

    assert {r["n"] for r in drift.custom_test(values, fn, "feature string, n long").collect()} == {300}


def test_importance_table_and_time_based_id(spark, tmp_path):
    from modelwatch.operators.cleaning import time_based_id

    log, label_table = scored_log(spark, 300)
    fitted = model.fit_forest(log.join(label_table.select("prediction_id", "true_label"), "prediction_id"), X, num_trees=5)
    table = model.feature_importance(spark, fitted, X)
    writers.write_importance(table, f"{tmp_path}/importance")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/importance").collect()]
    assert lines[0] == "feature,importance" and lines[1].startswith("x1,")
    assert model.top_features(table, 2).count() == 2
    got = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678901' AS t").select(time_based_id("t")).first()[0]
    assert got == "pred_20240102_030405_678901"
