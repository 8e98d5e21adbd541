"""The end of a round as one commit, and models replayed in one scan."""

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import model
from modelwatch.plans import rounds
from modelwatch.sources import commits

AT = "2024-05-01 00:00:00"


def versions(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('k', 1, 'Archived', 0.5D), ('k', 2, 'Production', 0.6D), ('m', 1, 'Production', 0.7D) AS t(model_name, version, stage, f1_score)"
    ).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("promoted_at", "archived_at", "updated_at")})


def decided(spark, *rows):
    return spark.createDataFrame(rows, "model_name string, shadow_model_version int, action string, feature_drift_ratio double")


def challengers(spark):
    return spark.sql("SELECT * FROM VALUES ('k', 3, 'Staging', 0.8D), ('m', 2, 'Staging', 0.1D) AS t(model_name, version, stage, f1_score)")


def stages(spark, root):
    return {(r["model_name"], r["version"]): r["stage"] for r in rounds.read_round(spark, root)["versions"].collect()}


def files(tmp_path):
    return sorted(str(p) for p in tmp_path.rglob("*.parquet"))


def test_a_round_changes_all_three_tables(spark, tmp_path):
    root = str(tmp_path)
    start = rounds.publish_round(spark, root, commits.latest(spark, root), versions(spark))
    assert set(rounds.read_round(spark, root)) == {"versions"}
    rounds.finish_round(spark, root, start, decided(spark, ("k", 3, "promote", 0.4), ("m", 2, "reject", None)), challengers(spark), AT)
    assert stages(spark, root) == {("k", 1): "Archived", ("k", 2): "Archived", ("k", 3): "Production", ("m", 1): "Production", ("m", 2): "Archived"}
    state = rounds.read_round(spark, root)
    assert state["decisions"].count() == 2 and {r["action"] for r in state["records"].collect()} == {"promote", "reject"}
    assert rounds.read_round(spark, root, start).keys() == {"versions"}


def test_a_stale_round_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    start = rounds.publish_round(spark, root, commits.latest(spark, root), versions(spark))
    rounds.finish_round(spark, root, start, decided(spark, ("m", 2, "reject", None)), challengers(spark), AT)
    before, there = stages(spark, root), files(tmp_path)
    with pytest.raises(commits.StaleVersion):
        rounds.finish_round(spark, root, start, decided(spark, ("k", 3, "promote", 0.1)), challengers(spark), AT)
    assert stages(spark, root) == before and files(tmp_path) == there


def test_a_broken_version_table_is_refused(spark, tmp_path):
    root = str(tmp_path)
    two = versions(spark).withColumn("stage", F.lit("Production"))
    with pytest.raises(ValueError):
        rounds.publish_round(spark, root, commits.latest(spark, root), two)
    assert commits.latest(spark, root).number == 0 and not files(tmp_path)


def test_unknown_versions_and_skips(spark, tmp_path):
    root = str(tmp_path)
    start = rounds.publish_round(spark, root, commits.latest(spark, root), versions(spark))
    none = challengers(spark).limit(0)
    rounds.finish_round(spark, root, start, decided(spark, ("k", 9, "promote", 0.1), ("m", 2, "skip", None)), none, AT)
    assert stages(spark, root) == {(r["model_name"], r["version"]): r["stage"] for r in versions(spark).collect()}
    assert [r["action"] for r in rounds.read_round(spark, root)["records"].collect()] == ["promote_failed"]


def test_many_rounds_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rounds, "MOST_FOLDERS", 3)
    root = str(tmp_path)
    at = rounds.publish_round(spark, root, commits.latest(spark, root), versions(spark))
    for i in range(6):
        at = rounds.publish_round(spark, root, at, versions(spark), decided(spark, ("k", i, "skip", None)))
    assert len(at.state["decisions"]) <= 4
    assert sorted(r["shadow_model_version"] for r in rounds.read_round(spark, root)["decisions"].collect()) == list(range(6))


def test_models_are_replayed_in_one_scan(spark, tmp_path):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    rows = rows.withColumn("true_label", (F.col("x") > 3).cast("int"))
    rows.write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    fitted = {n: model.fit_forest(rows, f, num_trees=3, max_depth=3) for n, f in {"a": ["x"], "b": ["x", "y"], "c": ["y"]}.items()}
    scored = model.replay(rows, fitted, ["x", "y"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    for name, one in fitted.items():
        alone = model.score(rows, one).select("id", "prediction", "probability").orderBy("id").collect()
        assert scored.where(F.col("model") == name).select("id", "prediction", "probability").orderBy("id").collect() == alone
    with pytest.raises(ValueError):
        model.replay(rows, {}, ["x"])


def test_a_decision_keeps_the_drift_and_versions_it_was_made_under(spark):
    from modelwatch.plans.retraining import retraining_round

    log = spark.sql(
        "SELECT prediction_id, t AS timestamp, t AS application_date FROM VALUES ('a', TIMESTAMP_NTZ '2024-04-29'), ('a', TIMESTAMP_NTZ '2024-04-30'), ('b', TIMESTAMP_NTZ '2024-04-30') AS v(prediction_id, t)"
    )
    known = spark.sql("SELECT 'a' AS prediction_id, 1 AS true_label, 1 AS days_delayed, TIMESTAMP_NTZ '2024-04-30' AS updated_at")
    seen = spark.sql("SELECT 0.4D AS feature_drift_ratio, 2 AS num_drifted_features, true AS dataset_drift_detected, array('x', 'y') AS drifted_features")
    out = retraining_round(log, known, ["x"], AT, None, drift=seen, production_version=3, trigger="drift_alert")
    row = out["decision"].first()
    assert (row["action"], row["trigger_reason"], row["production_model_version"], row["shadow_model_version"]) == ("skip", "drift_alert", 3, None)
    assert (row["feature_drift_ratio"], row["num_drifted_features"], row["dataset_drift_detected"], row["drifted_features"]) == (0.4, 2, True, ["x", "y"])
    assert out["duplicates"].first()["duplicate_rows"] == 1
    plain = retraining_round(log, known, ["x"], AT, None)["decision"]
    assert plain.columns == out["decision"].columns and plain.first()["feature_drift_ratio"] is None
