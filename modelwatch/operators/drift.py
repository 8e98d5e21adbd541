"""Distribution drift of features between a frozen reference and current rows.

One melted (feature, value, count, count) frame feeds every statistic: hash-aggregated map-side, so repeated
values never travel more than once per task, then turned into two empirical CDFs with bucketed running sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.special import chi_square_tail, kolmogorov_tail, normal_two_sided
from modelwatch.operators.ordered import BUCKET, Cuts, bucket_bound, plan_cuts, running_totals, with_bucket

# Report names of the tests.
TEST_NAMES = {
    "wasserstein": "Wasserstein distance (normed)",
    "jensenshannon": "Jensen-Shannon distance",
    "ks": "K-S p_value",
    "chisquare": "chi-square p_value",
    "z": "Z-test p_value",
}
P_VALUE_TESTS = ("ks", "chisquare", "z")


@dataclass(frozen=True)
class TestRule:
    """Use ``test`` for features of this kind with at most so many reference rows and distinct values."""

    __test__ = False

    test: str
    threshold: float
    categorical: bool | None = None
    max_reference_rows: int | None = None
    max_distinct: int | None = None


# First matching rule wins.
DEFAULT_RULES = (
    TestRule("z", 0.05, max_reference_rows=1000, max_distinct=2),
    TestRule("chisquare", 0.05, categorical=True, max_reference_rows=1000),
    TestRule("chisquare", 0.05, max_reference_rows=1000, max_distinct=5),
    TestRule("ks", 0.05, max_reference_rows=1000),
    TestRule("jensenshannon", 0.1, categorical=True),
    TestRule("jensenshannon", 0.1, max_distinct=5),
    TestRule("wasserstein", 0.1),
)


def melted(df: DataFrame, features: Sequence[str], cuts: Cuts, reference: bool) -> DataFrame:
    """One row per finite cell: feature (its position in the list), bucket, value, and 1 in the count of its side."""
    wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    buckets = {f: F.lit(0) for f in features}
    for i, f in enumerate(features):
        if cuts.get(f):
            wide = with_bucket(wide, f, cuts[f], f"_b{i}")
            buckets[f] = F.col(f"_b{i}")
    # Features travel as numbers: their names would be the widest part of a shuffled row.
    cells = [
        F.struct(F.lit(i).alias("feature"), buckets[f].alias(BUCKET), (F.col(f) + F.lit(0.0)).alias("value"))
        for i, f in enumerate(features)
    ]
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        wide.select(F.inline(F.array(*cells)))
        .filter(finite)
        .withColumns({"n_ref": one if reference else zero, "n_cur": zero if reference else one})
    )


def plan_feature_cuts(
    reference: DataFrame, current: DataFrame, features: Sequence[str], rows_per_bucket: int | None = None
) -> dict[str, list[float]]:
    """Cut values per feature, from sketches over both sides."""
    both = reference.select(*features).unionByName(current.select(*features))
    return plan_cuts(both, finite(features), rows_per_bucket)


def finite(features: Sequence[str]) -> dict[str, Column]:
    """Each feature with NaN and infinite values taken as missing."""
    return {
        f: F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf")), F.col(f))
        for f in features
    }


def value_table(
    reference: DataFrame, current: DataFrame, features: Sequence[str], cuts: Cuts, named: bool = True
) -> DataFrame:
    """Distinct (feature, value) with the reference and current counts; NULL, NaN and infinite values left out.

    With ``named=False`` a feature is its position in the list.
    """
    both = melted(reference, features, cuts, True).unionByName(melted(current, features, cuts, False))
    counts = both.groupBy("feature", BUCKET, "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    return name_features(counts, features) if named else counts


def name_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    return df.withColumn("feature", F.element_at(names, F.col("feature") + 1))


def category_table(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same for categorical features; values are compared as text."""

    def melt(df: DataFrame, n_ref: int, n_cur: int) -> DataFrame:
        text = df.select(*[F.col(f).cast("string").alias(f) for f in features])
        long = text.unpivot([], list(features), "feature", "value").filter("value IS NOT NULL")
        return long.withColumns({"n_ref": F.lit(n_ref).cast("bigint"), "n_cur": F.lit(n_cur).cast("bigint")})

    both = melt(reference, 1, 0).unionByName(melt(current, 0, 1))
    return both.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def _divergence(p: Column, q: Column) -> Column:
    """One value's part of the squared Jensen-Shannon distance."""
    mid = (p + q) / 2.0
    left = F.when(p > 0, F.lit(0.5) * p * F.ln(p / mid)).otherwise(F.lit(0.0))
    right = F.when(q > 0, F.lit(0.5) * q * F.ln(q / mid)).otherwise(F.lit(0.0))
    return left + right


def _frequency_aggregates() -> list[Column]:
    """Statistics that need only a value's two counts and the two totals."""
    # Counts as doubles: their products leave the range of integers at a few billion rows.
    p, q = F.col("n_ref") / F.col("all_ref"), F.col("n_cur") / F.col("all_cur")
    expected = F.col("n_ref").cast("double") * F.col("all_cur").cast("double") / F.col("all_ref")
    gap = F.col("n_cur") - expected
    known = F.when(F.col("n_ref") > 0, F.col("value"))
    return [
        F.max("all_ref").alias("n_reference"),
        F.max("all_cur").alias("n_current"),
        F.count(F.when(F.col("n_ref") > 0, True)).alias("n_distinct"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(_divergence(p, q)))).alias("js_distance"),
        F.sum(F.when(expected > 0, gap * gap / expected)).alias("chi2"),
        F.max((F.col("n_ref") == 0) & (F.col("n_cur") > 0)).alias("unseen"),
        F.max_by("n_ref", known).alias("top_ref"),
        F.max_by("n_cur", known).alias("top_cur"),
    ]


def numeric_statistics(values: DataFrame, bucketed: bool = True, offset_rows: int | None = None) -> DataFrame:
    """Every statistic per numeric feature, from one pass over the ordered values."""
    ordered = running_totals(
        values,
        ["feature"],
        ["value"],
        sums={"upto_ref": "n_ref", "upto_cur": "n_cur"},
        totals={"all_ref": "n_ref", "all_cur": "n_cur", "sum_ref": F.col("n_ref").cast("double") * F.col("value")},
        next_value={"following": "value"},
        bucket=BUCKET if bucketed else None,
        offset_rows=offset_rows,
    )
    gap = F.abs(F.col("upto_ref") / F.col("all_ref") - F.col("upto_cur") / F.col("all_cur"))
    off = F.col("value") - F.col("sum_ref") / F.col("all_ref")
    usable = ordered.filter((F.col("all_ref") > 0) & (F.col("all_cur") > 0))
    stats = usable.groupBy("feature").agg(
        *_frequency_aggregates(),
        F.coalesce(F.sum(gap * (F.col("following") - F.col("value"))), F.lit(0.0)).alias("w1"),
        F.max(gap).alias("ks_distance"),
        F.sqrt(F.sum(F.col("n_ref") * off * off) / F.max("all_ref")).alias("ref_std"),
    )
    return stats.withColumns(
        {
            "wasserstein": F.col("w1") / F.greatest("ref_std", F.lit(0.001)),
            "ks_p": kolmogorov_tail(F.col("ks_distance"), F.col("n_reference"), F.col("n_current")),
            **_frequency_tests(),
        }
    ).drop("top_ref", "top_cur")


def categorical_statistics(values: DataFrame) -> DataFrame:
    """Frequency statistics per categorical feature; distances over an order are NULL."""
    totals = values.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    usable = values.join(totals.filter("all_ref > 0 AND all_cur > 0"), "feature")
    stats = usable.groupBy("feature").agg(*_frequency_aggregates())
    nothing = F.lit(None).cast("double")
    return stats.withColumns(
        {
            "w1": nothing,
            "ks_distance": nothing,
            "ref_std": nothing,
            "wasserstein": nothing,
            "ks_p": nothing,
            **_frequency_tests(),
        }
    ).drop("top_ref", "top_cur")


def _frequency_tests() -> dict[str, Column]:
    """chi-square p-value and the two-proportion z test on the largest reference value."""
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    pooled = (F.col("top_ref") + F.col("top_cur")) / (n + m)
    spread = F.sqrt(pooled * (1.0 - pooled) * (1.0 / n + 1.0 / m))
    z = F.coalesce(F.try_divide(F.col("top_ref") / n - F.col("top_cur") / m, spread), F.lit(0.0))
    degrees = F.col("n_distinct") - 1
    chi_p = F.when(F.col("unseen"), F.lit(0.0)).when(degrees < 1, F.lit(1.0))
    return {
        "chi2_p": chi_p.otherwise(chi_square_tail(F.col("chi2"), F.greatest(degrees, F.lit(1)))),
        "z": z,
        "z_p": normal_two_sided(z),
    }


def feature_statistics(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str] = (),
    cuts: Cuts | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Statistics of every listed feature that has rows on both sides."""
    numeric = [f for f in features if f not in set(categorical)]
    parts = []
    if numeric:
        cuts = cuts if cuts is not None else plan_feature_cuts(reference, current, numeric, rows_per_bucket)
        values = value_table(reference, current, numeric, cuts, named=False)
        bound = sum(bucket_bound(cuts.get(f, ())) for f in numeric)
        stats = numeric_statistics(values, bucketed=any(cuts.values()), offset_rows=bound)
        parts.append(name_features(stats, numeric).withColumn("categorical", F.lit(False)))
    if categorical:
        stats = categorical_statistics(category_table(reference, current, list(categorical)))
        parts.append(stats.withColumn("categorical", F.lit(True)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def select_tests(
    statistics: DataFrame,
    rules: Sequence[TestRule] = DEFAULT_RULES,
    overrides: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Pick a test per feature and judge it: feature, test, threshold, statistic, p-value, score, drifted."""
    chosen: Column | None = None

    def pick(test: str, threshold: float) -> Column:
        return F.struct(F.lit(test).alias("test"), F.lit(float(threshold)).alias("threshold"))

    def add(condition: Column, test: str, threshold: float) -> None:
        nonlocal chosen
        value = pick(test, threshold)
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)

    for feature, (test, threshold) in (overrides or {}).items():
        add(F.col("feature") == feature, test, threshold)
    for rule in rules:
        condition = F.lit(True)
        if rule.categorical is not None:
            condition = condition & (F.col("categorical") == rule.categorical)
        if rule.max_reference_rows is not None:
            condition = condition & (F.col("n_reference") <= rule.max_reference_rows)
        if rule.max_distinct is not None:
            condition = condition & (F.col("n_distinct") <= rule.max_distinct)
        add(condition, rule.test, rule.threshold)
    picked = statistics.withColumn("_pick", chosen)
    test = F.col("_pick.test")
    statistic = (
        F.when(test == "wasserstein", F.col("wasserstein"))
        .when(test == "jensenshannon", F.col("js_distance"))
        .when(test == "ks", F.col("ks_distance"))
        .when(test == "chisquare", F.col("chi2"))
        .when(test == "z", F.col("z"))
    )
    p_value = (
        F.when(test == "ks", F.col("ks_p")).when(test == "chisquare", F.col("chi2_p")).when(test == "z", F.col("z_p"))
    )
    judged = picked.select(
        "feature",
        test.alias("test"),
        F.col("_pick.threshold").alias("threshold"),
        statistic.alias("statistic"),
        p_value.alias("p_value"),
        "n_reference",
        "n_current",
    )
    low_p = F.when(F.col("test") == "ks", F.col("p_value") <= F.col("threshold")).otherwise(
        F.col("p_value") < F.col("threshold")
    )
    by_p = F.col("test").isin(*P_VALUE_TESTS)
    return judged.withColumns(
        {
            "drift_score": F.when(by_p, F.col("p_value")).otherwise(F.col("statistic")),
            "drift_detected": F.when(by_p, low_p).otherwise(F.col("statistic") >= F.col("threshold")),
        }
    )


def detect_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str] = (),
    rules: Sequence[TestRule] = DEFAULT_RULES,
    overrides: Mapping[str, tuple[str, float]] | None = None,
    cuts: Cuts | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """One judged row per evaluated feature."""
    stats = feature_statistics(reference, current, features, categorical, cuts, rows_per_bucket)
    return select_tests(stats, rules, overrides)


def drift_summary(feature_rows: DataFrame, features: Sequence[str], share_threshold: float = 0.5) -> DataFrame:
    """One row: how many features were evaluated, excluded and drifted, and whether the dataset drifted.

    The observed ratio and the share threshold are separate columns. Without any evaluated feature (for
    example no current rows) the status is ``no_data``.
    """
    spark = feature_rows.sparkSession
    wanted = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string")
    joined = wanted.join(feature_rows.select("feature", "drift_detected"), "feature", "left")
    missing = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("drift_detected").isNull(), F.struct("position", "feature")))),
        lambda x: x["feature"],
    )
    drifted = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.struct("position", "feature")))),
        lambda x: x["feature"],
    )
    counted = joined.agg(
        F.count(F.lit(1)).cast("int").alias("num_features_total"),
        F.count("drift_detected").cast("int").alias("num_features_evaluated"),
        F.count(F.when(F.col("drift_detected"), True)).cast("int").alias("num_drifted_features"),
        missing.alias("excluded_features"),
        drifted.alias("drifted_features"),
    )
    ratio = F.coalesce(F.try_divide("num_drifted_features", "num_features_evaluated"), F.lit(0.0))
    evaluated = F.col("num_features_evaluated") > 0
    return counted.withColumns(
        {
            "num_features_excluded": F.col("num_features_total") - F.col("num_features_evaluated"),
            "feature_drift_ratio": ratio,
            "drift_share_threshold": F.lit(float(share_threshold)),
            "dataset_drift_detected": evaluated & (ratio >= share_threshold),
            "status": F.when(evaluated, "ok").otherwise("no_data"),
        }
    )


def summary_document(feature_rows: DataFrame, summary: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """The summary as one nested record, features in an array, as it is stored in JSON."""
    names = F.create_map(*[F.lit(x) for pair in TEST_NAMES.items() for x in pair])
    entry = F.struct(
        "feature",
        "drift_detected",
        names[F.col("test")].alias("stat_test"),
        "p_value",
        "threshold",
        "drift_score",
    )
    listed = feature_rows.agg(F.array_sort(F.collect_list(entry)).alias("features"))
    # Both sides are single rows.
    doc = summary.withColumn("_k", F.lit(1)).join(listed.withColumn("_k", F.lit(1)), "_k")
    doc = doc.withColumn("drift_share", F.col("drift_share_threshold"))
    if metadata is not None:
        packed = metadata.select(F.struct(*metadata.columns).alias("reference_metadata"), F.lit(1).alias("_k"))
        doc = doc.join(packed, "_k")
    return doc.drop("_k")


def binned_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by, feature, bin). Bin columns hold few values; the counts merge by addition."""
    text = df.select(*by, *[F.col(f).cast("string").alias(f) for f in features])
    long = text.unpivot(list(by), list(features), "feature", "bin").filter("bin IS NOT NULL")
    return long.groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def binned_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    by: Sequence[str],
    threshold: float = 0.1,
    reference_counts: DataFrame | None = None,
    current_counts: DataFrame | None = None,
) -> DataFrame:
    """Jensen-Shannon distance of binned features for many groups (runs, models) against one reference.

    The reference histogram has a few rows per feature. Bins a group lacks contribute a closed-form rest,
    so groups are not crossed with bins.
    """
    ref = reference_counts if reference_counts is not None else binned_counts(reference, features)
    cur = current_counts if current_counts is not None else binned_counts(current, features, by)
    q = F.col("n") / F.sum("n").over(Window.partitionBy("feature"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "feature"))
    ref_share = ref.select("feature", "bin", q.alias("q"))
    cur_share = cur.select(*by, "feature", "bin", p.alias("p"))
    joined = cur_share.join(ref_share, ["feature", "bin"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    rest = F.lit(0.5 * 0.6931471805599453) * (F.lit(1.0) - F.sum("q"))
    distance = F.sqrt(F.greatest(F.lit(0.0), F.sum(_divergence(F.col("p"), F.col("q"))) + rest))
    scored = joined.groupBy(*by, "feature").agg(distance.alias("drift_score"))
    return scored.withColumn("drift_detected", F.col("drift_score") >= threshold)


def ratio_per_run(feature_rows: DataFrame, by: Sequence[str], share_threshold: float = 0.5) -> DataFrame:
    """Drift counts and ratio per group; drifted feature names as a sorted comma list."""
    names = F.array_sort(F.collect_set(F.when(F.col("drift_detected"), F.col("feature"))))
    out = feature_rows.groupBy(*by).agg(
        F.count(F.when(F.col("drift_detected"), True)).cast("int").alias("num_drifted_features"),
        F.avg(F.col("drift_detected").cast("double")).alias("feature_drift_ratio"),
        F.array_join(names, ",").alias("drifted_features"),
    )
    return out.withColumn("dataset_drift_detected", F.col("feature_drift_ratio") >= share_threshold)


def parse_summaries(summaries: DataFrame, time: str = "report_time", legacy_share: bool = False) -> DataFrame:
    """Score and drifted names of stored summaries in any of their three layouts.

    Names come from ``features``, else ``feature_drift_details``, else ``drifted_features`` - the first that
    yields any. The score is the observed drift ratio; ``legacy_share`` takes the stored ``drift_share``
    (which holds the dataset threshold) instead, to replay old decisions.
    """

    def drifted(column: str) -> Column:
        rows = F.filter(F.col(column), lambda x: F.coalesce(x["drift_detected"], F.lit(False)))
        return F.transform(rows, lambda x: x["feature"])

    nothing = F.array().cast("array<string>")
    choices = [F.coalesce(drifted(c), nothing) for c in ("features", "feature_drift_details")]
    choices.append(F.coalesce(F.col("drifted_features"), nothing))
    names = F.when(F.size(choices[0]) > 0, choices[0]).when(F.size(choices[1]) > 0, choices[1]).otherwise(choices[2])
    observed = F.coalesce(
        F.col("feature_drift_ratio"),
        F.try_divide("num_drifted_features", "num_features_evaluated"),
        F.try_divide(F.col("num_drifted_features"), F.size("features")),
    )
    score = F.col("drift_share") if legacy_share else observed
    return summaries.select(time, F.coalesce(score, F.lit(0.0)).alias("score"), names.alias("names"))


def fold_signal(
    reports: DataFrame, by: Sequence[str] = (), threshold: float = 0.3, time: str = "report_time"
) -> DataFrame:
    """Fold recent parsed reports (time, score, names) into one signal per group."""
    hit = (F.col("score") >= threshold) & (F.size("names") > 0)
    folded = reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_reports_checked"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("drift_share"),
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("drift_detected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("names")))))).alias(
            "drifted_feature_names"
        ),
        F.sort_array(F.collect_set(F.when(hit, F.col(time))), asc=False).alias("drift_timestamps"),
    )
    return folded.withColumns(
        {
            "num_drifted_features": F.size("drifted_feature_names"),
            "drift_threshold": F.lit(float(threshold)),
            "status": F.when(F.col("num_reports_checked") == 0, "no_recent_reports").otherwise("ok"),
        }
    )


def recommendation(signal: DataFrame, lookback_hours: int) -> DataFrame:
    """The retraining recommendation read from a signal."""
    return signal.withColumns(
        {"retraining_recommended": F.col("drift_detected"), "lookback_hours": F.lit(lookback_hours)}
    )


def alert_levels(runs: DataFrame) -> DataFrame:
    """Alert level per run from the drift share, volume per hour, feature count and dataset flag."""
    hourly = F.col("num_predictions") / F.col("lookback_hours")
    share = F.col("feature_drift_ratio")
    return runs.withColumns(
        {
            "drift_level": F.when(share > 0.5, "critical").when(share >= 0.3, "warning").otherwise("normal"),
            "volume_level": F.when(hourly < 10, "critical").when(hourly < 50, "warning").otherwise("normal"),
            "inspect": share > 0.2,
            "many_features": F.col("num_drifted_features") > 5,
            "log_alert": F.col("dataset_drift_detected"),
        }
    )


def recent_drift_alerts(runs: DataFrame, limit: int = 10, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """The newest runs with dataset drift (a top-k report)."""
    return runs.filter("dataset_drift_detected").orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def custom_test(values: DataFrame, fn, schema: str) -> DataFrame:
    """Run a caller's pandas function per feature over (feature, value, n_ref, n_cur) rows.

    For features with few distinct values: one feature's distinct values go to one task.
    """
    return values.select("feature", "value", "n_ref", "n_cur").groupBy("feature").applyInPandas(fn, schema)
