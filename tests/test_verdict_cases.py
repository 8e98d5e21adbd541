"""Cases that once gave wrong answers: large chi-square arguments, huge counts, missing features, unknown versions."""

import math

import pytest
from pyspark.sql import functions as F

from modelwatch.functions.special import MOST_DEGREES, chi_square_tail
from modelwatch.operators import drift, fingerprint, labels, model, registry
from modelwatch.session import scratch_dir


def tail(statistic, degrees):
    """Finite sums of the chi-square tail."""
    x = statistic / 2
    if x <= 0:
        return 1.0
    if degrees % 2 == 0:
        return min(1.0, math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(degrees // 2)))
    rest = math.fsum(math.exp((k - 0.5) * math.log(x) - x - math.lgamma(k + 0.5)) for k in range(1, (degrees + 1) // 2))
    return min(1.0, math.erfc(math.sqrt(x)) + rest)


def test_chi_square_tail_from_1_to_5000_degrees(spark):
    cases = [(700.0, 700), (900.0, 999), (340.0, 338), (580.0, 600), (400.0, 360)]
    for degrees in (1, 2, 3, 4, 5, 9, 10, 50, 99, 333, 600, 1000, 2501, 5000):
        cases += [(degrees * f, degrees) for f in (0.01, 0.5, 0.9, 1.0, 1.05, 1.1, 1.5, 3.0)]
    rows = spark.createDataFrame(cases, "s double, d long").select("s", "d", chi_square_tail(F.col("s"), F.col("d")).alias("p"))
    for s, d, p in rows.collect():
        assert 0 <= p <= 1 and p == pytest.approx(tail(s, d), abs=1e-9), (s, d)


def test_chi_square_tail_beyond_the_exact_degrees(spark):
    cases = [(MOST_DEGREES + d, MOST_DEGREES + e) for d in (-5000.0, 0.0, 5000.0) for e in (0, 2)]
    rows = spark.createDataFrame(cases, "s double, d long").select("s", "d", chi_square_tail(F.col("s"), F.col("d")).alias("p"))
    got = {(s, d): p for s, d, p in rows.collect()}
    for s in {c[0] for c in cases}:
        assert got[s, MOST_DEGREES] == pytest.approx(got[s, MOST_DEGREES + 2], abs=1e-3)
        want = 0.5 * math.erfc((s - MOST_DEGREES) / math.sqrt(2 * MOST_DEGREES) / math.sqrt(2))
        assert got[s, MOST_DEGREES] == pytest.approx(want, abs=1e-3)


def test_many_categories_are_judged(spark):
    ref = spark.range(900).select((F.col("id") % 450).cast("string").alias("c"))
    found = drift.detect_drift(ref, ref, ["c"], categorical=["c"]).first()
    assert found["drift_score"] == pytest.approx(1.0) and not found["drift_detected"]


def test_counts_of_billions(spark):
    rows = [("f", 1.0, 5_000_000_000, 4_000_000_000), ("f", 2.0, 5_000_000_000, 6_000_000_000)]
    values = spark.createDataFrame(rows, "feature string, value double, n_ref long, n_cur long")
    found = drift.numeric_statistics(values, bucketed=False).first()
    assert found["ks_distance"] == pytest.approx(0.1) and found["chi2"] == pytest.approx(4e8) and found["chi2_p"] < 1e-100
    text = values.withColumn("value", F.col("value").cast("string"))
    assert drift.categorical_statistics(text).first()["chi2"] == pytest.approx(4e8)


def test_scoring_keeps_rows_with_missing_features(spark):
    x = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 10)
    rows = spark.range(200).select("id", x.cast("double").alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") % 10 >= 5).cast("int").alias("true_label"))
    fitted = {n: model.fit_forest(rows, ["x", "y"], num_trees=n, max_depth=3) for n in (3, 5)}
    scored = model.replay(rows, {str(n): f for n, f in fitted.items()}, ["x", "y"])
    assert {(r["model"], r["count"]) for r in scored.groupBy("model").count().collect()} == {("3", 200), ("5", 200)}
    assert scored.where("probability IS NULL OR prediction IS NULL").isEmpty()


def versions(spark):
    return spark.sql(
        """SELECT * FROM VALUES
           ('m', 1, 'Archived', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-02-01', TIMESTAMP_NTZ '2024-02-01'),
           ('m', 2, 'Production', TIMESTAMP_NTZ '2024-02-01', NULL, TIMESTAMP_NTZ '2024-02-01'),
           ('k', 1, 'Archived', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-03-01', TIMESTAMP_NTZ '2024-03-01')
           AS t(model_name, version, stage, promoted_at, archived_at, updated_at)"""
    )


def test_unknown_version_changes_nothing(spark):
    before = versions(spark)
    target = spark.createDataFrame([("m", 99)], "model_name string, version int")
    for change in (registry.promote, registry.rollback, registry.reject):
        after = change(before, target, "2024-05-01 00:00:00")
        assert sorted(map(tuple, after.collect()), key=repr) == sorted(map(tuple, before.collect()), key=repr)


def test_archived_without_successor_is_not_in_production(spark):
    asked = spark.sql("SELECT * FROM VALUES ('k', TIMESTAMP_NTZ '2024-02-15'), ('k', TIMESTAMP_NTZ '2024-03-01'), ('m', TIMESTAMP_NTZ '2024-02-01') AS t(model_name, timestamp)")
    found = {(r[0], str(r[1])[:10]): r[2] for r in registry.production_at(asked, versions(spark)).collect()}
    assert found == {("k", "2024-02-15"): 1, ("k", "2024-03-01"): None, ("m", "2024-02-01"): 2}


def print_of(spark, rows, schema):
    return fingerprint.fingerprint(spark.createDataFrame(rows, schema)).first()["dataset_hash"]


def test_fingerprints_differ_where_tables_differ(spark):
    pairs = [
        (([(1e-7,)], "a double"), ([(4e-7,)], "a double")),
        (([("a|b", "c")], "a string, b string"), ([("a", "b|c")], "a string, b string")),
        (([(None,)], "a string"), ([("\\N",)], "a string")),
        (([("x",)], "a string"), ([("x",)], "c string")),
        (([(1e300,)], "a double"), ([(1.0000000000000002e300,)], "a double")),
        (([(float("nan"),)], "a double"), ([(None,)], "a double")),
    ]
    for one, other in pairs:
        assert print_of(spark, *one) != print_of(spark, *other)
    assert print_of(spark, [(1, "x"), (2, "y")], "a int, b string") == print_of(spark, [(2, "y"), (1, "x")], "a int, b string")


def test_repeated_predictions_give_one_training_row(spark):
    log = spark.sql("SELECT * FROM VALUES ('a', 1, 0.2), ('a', 2, 0.3), ('b', 1, 0.4) AS t(prediction_id, timestamp, x)")
    truth = spark.sql("SELECT * FROM VALUES ('a', 1, 3, 1), ('b', 0, 4, 1) AS t(prediction_id, true_label, days_delayed, updated_at)")
    rows = labels.training_rows(log, truth)
    assert sorted((r["prediction_id"], float(r["x"])) for r in rows.collect()) == [("a", 0.3), ("b", 0.4)]


def test_scratch_needs_a_shared_folder_off_local_mode():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf(conf)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            scratch_dir(Session(**{"spark.master": master}), "x")
    assert scratch_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"}), "x").startswith("hdfs://a/b/x-")
    assert scratch_dir(Session(**{"spark.master": "local[4]"}), "x")
