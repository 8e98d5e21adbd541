"""Closed-form cases and metamorphic checks of the statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.functions.bins import INTERIOR_EDGES, left_closed_bin, right_closed_bin
from modelwatch.functions.special import chi_square_tail, kolmogorov_tail, normal_two_sided
from modelwatch.operators import drift, evaluate, perturb, proxy


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def scores(spark, values, predictions=None):
    return frame(spark, probability=[float(x) for x in values], prediction=predictions or [0] * len(values))


def test_bin_edges(spark):
    edges = [0.0, *INTERIOR_EDGES, 1.0, 0.3, 1.2]
    rows = scores(spark, edges).select(
        "probability", left_closed_bin("probability").alias("l"), right_closed_bin("probability").alias("r")
    )
    got = {r["probability"]: (r["l"], r["r"]) for r in rows.collect()}
    numpy_bins = np.linspace(0, 1, 11)
    for p in edges[:-1]:
        hist, _ = np.histogram([p], bins=numpy_bins)
        assert got[p][0] == int(hist.argmax())
        assert got[p][1] == int(np.searchsorted(numpy_bins[1:-1], p))
    assert got[1.2][0] is None


def test_entropy_of_one_full_bin_and_of_equal_bins(spark):
    one = proxy.probability_entropy(scores(spark, [0.55] * 50)).first()["entropy"]
    ten = proxy.probability_entropy(scores(spark, [i / 10 + 0.05 for i in range(10)])).first()["entropy"]
    assert one == pytest.approx(0.0, abs=1e-6)
    assert ten == pytest.approx(math.log(10), abs=1e-8)


def test_empty_log(spark):
    empty = spark.createDataFrame([], "prediction int, probability double, timestamp timestamp")
    assert proxy.probability_entropy(empty).first()["entropy"] == 0.0
    assert proxy.distribution_stats(empty).first()["status"] == "no_data"
    assert {r["status"] for r in proxy.trailing_trends(empty).collect()} == {"no_data"}


def test_std_of_one_row_is_null(spark):
    assert proxy.distribution_stats(scores(spark, [0.4])).first()["probability_std"] is None


def stats(spark, ref, cur, **kw):
    a, b = frame(spark, x=np.asarray(ref, float)), frame(spark, x=np.asarray(cur, float))
    return drift.feature_statistics(a, b, ["x"], **kw).first()


def test_shift_by_c_has_distance_c(spark):
    base = np.arange(0, 50, 0.5)
    row = stats(spark, base, base + 3.25)
    assert row["w1"] == pytest.approx(3.25)
    assert row["ref_std"] == pytest.approx(base.std())


def test_identical_data_has_no_drift(spark):
    base = np.random.default_rng(1).normal(size=300)
    row = stats(spark, base, base)
    assert row["w1"] == row["ks_distance"] == 0.0
    assert row["js_distance"] == pytest.approx(0.0, abs=1e-9)
    assert row["ks_p"] == 1.0


def test_disjoint_samples(spark):
    row = stats(spark, range(100), range(1000, 1100))
    assert row["ks_distance"] == 1.0
    assert row["js_distance"] == pytest.approx(math.sqrt(math.log(2)))
    assert row["ks_p"] < 1e-6


def test_bucketed_path_equals_plain_path(spark):
    rng = np.random.default_rng(3)
    ref, cur = np.round(rng.gamma(2, 2, 3000), 2), np.round(rng.gamma(2.2, 2, 2500), 2)
    plain, cut = stats(spark, ref, cur), stats(spark, ref, cur, rows_per_bucket=50)
    for name in ("w1", "ks_distance", "js_distance", "ref_std", "chi2"):
        assert plain[name] == pytest.approx(cut[name], rel=1e-9)


def test_nan_null_and_infinite_values_are_left_out(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    row = drift.feature_statistics(ref, ref, ["x"]).first()
    assert row["n_reference"] == 2


def test_one_sided_feature_is_excluded(spark):
    ref = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    cur = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0)], "x double, y double")
    found = drift.detect_drift(ref, cur, ["x", "y"])
    summary = drift.drift_summary(found, ["x", "y"]).first()
    assert summary["excluded_features"] == ["y"]
    assert summary["num_features_evaluated"] == 1


def test_no_current_rows_is_no_data(spark):
    ref = frame(spark, x=[1.0, 2.0])
    found = drift.detect_drift(ref, ref.filter("x > 5"), ["x"])
    row = drift.drift_summary(found, ["x"]).first()
    assert row["status"] == "no_data" and not row["dataset_drift_detected"]


@pytest.mark.parametrize("statistic,degrees,want", [(3.841459, 1, 0.05), (9.487729, 4, 0.05), (11.344867, 3, 0.01), (0.0, 2, 1.0)])
def test_chi_square_tail(spark, statistic, degrees, want):
    got = spark.range(1).select(chi_square_tail(F.lit(statistic), F.lit(degrees))).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, -2.5, 5.0])
def test_normal_tail(spark, z):
    got = spark.range(1).select(normal_two_sided(F.lit(z))).first()[0]
    assert got == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


def test_kolmogorov_tail(spark):
    # Tabulated: the 5 % point of the limiting distribution is 1.3581.
    n = 10_000
    got = spark.range(1).select(kolmogorov_tail(F.lit(1.3581 / math.sqrt(n / 2)), F.lit(n), F.lit(n))).first()[0]
    assert got == pytest.approx(0.05, abs=1e-4)


def chosen(spark, n, values, categorical=False):
    rng = np.random.default_rng(5)
    data = frame(spark, x=rng.choice(values, n))
    found = drift.detect_drift(data, data, ["x"], categorical=["x"] if categorical else [])
    return found.first()["test"]


@pytest.mark.parametrize(
    "n,values,categorical,want",
    [
        (500, list(range(50)), False, "ks"),
        (500, [1, 2, 3, 4], False, "chisquare"),
        (500, [0, 1], False, "z"),
        (2000, list(range(50)), False, "wasserstein"),
        (2000, [1, 2, 3], False, "jensenshannon"),
        (2000, list(range(50)), True, "jensenshannon"),
        (500, list(range(50)), True, "chisquare"),
        (500, [0, 1], True, "z"),
    ],
)
def test_test_selection(spark, n, values, categorical, want):
    assert chosen(spark, n, values, categorical) == want


def test_override_wins(spark):
    data = frame(spark, x=np.arange(2000.0))
    found = drift.detect_drift(data, data, ["x"], overrides={"x": ("ks", 0.01)}).first()
    assert (found["test"], found["threshold"]) == ("ks", 0.01)


def test_scaling_and_shifting_raise_the_distance(spark):
    rng = np.random.default_rng(42)
    data = frame(spark, income=rng.uniform(1000, 15000, 1500), age=rng.integers(18, 80, 1500).astype(float))
    moved = perturb.shift_feature(perturb.scale_feature(data, "income", 1.5), "age", 10)
    found = {r["feature"]: r["drift_detected"] for r in drift.detect_drift(data, moved, ["income", "age"]).collect()}
    assert found == {"income": True, "age": True}


def labeled(spark, y, p):
    return frame(spark, true_label=y, probability=[float(x) for x in p], prediction=[int(x >= 0.5) for x in p])


def test_auc_cases(spark):
    auc = lambda y, p: evaluate.roc_auc(labeled(spark, y, p)).first()["roc_auc"]
    assert auc([0, 1, 0, 1], [0.5] * 4) == 0.5
    assert auc([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == 1.0
    assert auc([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]) == 0.75
    assert auc([1, 1], [0.2, 0.7]) is None


def test_auc_agrees_with_the_library_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 3000)
    p = np.clip(rng.normal(0.4 + 0.1 * y, 0.2), 0, 1)
    rows = labeled(spark, y.tolist(), p.tolist())
    whole = evaluate.roc_auc(rows, rows_per_bucket=100).first()["roc_auc"]
    checker = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="true_label", numBins=0)
    assert whole == pytest.approx(checker.evaluate(rows.withColumn("true_label", F.col("true_label").cast("double"))), abs=1e-9)


def test_rates_with_zero_denominators(spark):
    row = evaluate.evaluate(labeled(spark, [0, 0], [0.1, 0.2])).first()
    assert (row["precision"], row["recall"], row["f1_score"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert row["roc_auc"] is None and row["leak_suspected"]


def test_no_labels(spark):
    empty = spark.createDataFrame([], "true_label int, probability double, prediction int")
    assert evaluate.evaluate(empty).first()["status"] == "no_labels"


def test_unweighted_calibration_error(spark):
    # Two bins: gaps 0.05 (one row) and 0.25 (three rows).
    rows = labeled(spark, [0, 1, 1, 1], [0.05, 0.75, 0.75, 0.75])
    assert evaluate.expected_calibration_error(rows).first()[0] == pytest.approx(0.15)
    weighted = evaluate.expected_calibration_error(rows).first()[1]
    assert weighted == pytest.approx((0.05 + 3 * 0.25) / 4)


def test_small_and_null_segments_are_left_out(spark):
    rows = labeled(spark, [0, 1] * 40, [0.2, 0.8] * 40).withColumn("i", F.monotonically_increasing_id())
    seg = F.when(F.col("i") % 8 == 0, "small").when(F.col("i") % 8 < 5, "large")
    found = evaluate.segment_metrics(rows.withColumn("seg", seg), ["seg"]).collect()
    assert [r["segment"] for r in found] == ["large"]


def test_comparison_of_missing_model(spark):
    metrics = evaluate.evaluate(labeled(spark, [0, 1], [0.2, 0.9])).withColumn("model", F.lit("production"))
    assert evaluate.compare_models(metrics).first()["status"] == "insufficient_data"


def test_stored_reference_is_not_read_as_rows(spark, tmp_path):
    """Drift against stored values equals drift against the rows, with small buckets too, and does not scan the rows."""
    from modelwatch.operators import reference_values

    rng = np.random.default_rng(11)
    frame = lambda n, shift: spark.createDataFrame([(float(x), float(round(y, 1)), None if i % 9 else 1.0) for i, (x, y) in enumerate(rng.normal(shift, 1, (n, 2)))], "a double, b double, c double")
    frame(3000, 0).write.parquet(f"{tmp_path}/rows")
    reference, current = spark.read.parquet(f"{tmp_path}/rows"), frame(1200, 0.4)
    for name, size in (("plain", None), ("small", 50)):
        reference_values.store_reference_values(reference, ["a", "b", "c"], f"{tmp_path}/{name}", size)
        stored = reference_values.open_reference_values(spark, f"{tmp_path}/{name}")
        found = reference_values.drift_from_stored(stored, current)
        assert found.inputFiles() and all(f"/{name}/values/" in f for f in found.inputFiles())
        want = {r["feature"]: r for r in drift.detect_drift(reference, current, ["a", "b", "c"]).collect()}
        for r in found.collect():
            assert r["test"] == want[r["feature"]]["test"] and r["drift_detected"] == want[r["feature"]]["drift_detected"]
            assert r["statistic"] == pytest.approx(want[r["feature"]]["statistic"])
        assert len(want) == 3
