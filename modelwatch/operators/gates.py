"""Retraining need and the ordered promotion gates, for many candidates at once.

Each candidate is a row; a gate is a boolean expression on it. All six gates are judged in one projection, so
deciding a million candidates costs one scan. The first failing gate decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.times import micros, whole_days
from modelwatch.operators.ordered import BUCKET, join_on, plan_cuts, running_totals, with_bucket


@dataclass(frozen=True)
class GateLimits:
    """Thresholds of the gates."""

    min_f1_improvement_pct: float = 2.0
    max_brier_degradation: float = 0.01
    max_segment_regression_pct: float = 5.0
    min_samples: int = 200
    min_coverage_pct: float = 30.0
    cooldown_days: int = 7
    extra: Mapping[str, Column] = field(default_factory=dict)


# Gate names in the order they are judged.
GATES = [
    "sufficient_samples",
    "minimum_coverage",
    "promotion_cooldown",
    "metric_improvement",
    "calibration_maintained",
    "no_segment_regression",
]

MIN_LABELED = 200
MIN_COVERAGE_RATE = 0.2


def retraining_need(
    context: DataFrame, min_labeled: int = MIN_LABELED, min_coverage: float = MIN_COVERAGE_RATE, trigger: str = "scheduled"
) -> DataFrame:
    """Train or skip, from coverage columns joined with drift columns. Drift is context; who asked is the ``trigger``."""
    enough = (F.col("labeled_predictions") >= min_labeled) & (F.col("coverage_rate") >= min_coverage)
    enough = F.coalesce(enough, F.lit(False))
    return context.withColumns(
        {
            "action": F.when(enough, "train").otherwise("skip"),
            "trigger_reason": F.lit(trigger),
            "reason": F.when(enough, "enough labels to train").otherwise("too few labels"),
        }
    )


def last_promotion(decisions: DataFrame, now: Column, by: Sequence[str] = ("model_name",), time: str = "timestamp"):
    """Newest promotion per model up to ``now``."""
    past = decisions.filter((F.col("action") == "promote") & (F.col(time) <= now))
    return past.groupBy(*by).agg(F.max(time).alias("last_promotion"))


def promotion_before(
    decisions: DataFrame,
    by: Sequence[str] = ("model_name",),
    time: str = "timestamp",
    tie_break: str = "id",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Replay form: for every decision the newest earlier promotion of its model.

    The running maximum is taken over distinct times per model, cut along time, so neither a model with a long
    history nor a time with very many decisions sits on one task. Decisions at the same time are ordered by
    the tie break: a promotion with a smaller one counts as earlier.
    """
    cuts = plan_cuts(decisions, {"t": micros(time)}, rows_per_bucket)["t"]
    promoted = F.col("action") == "promote"
    moments = with_bucket(decisions, micros(time), cuts).groupBy(*by, BUCKET, time).agg(
        F.min(F.when(promoted, F.col(tie_break))).alias("_first_promoted")
    )
    carried = running_totals(
        moments,
        by,
        [time],
        maxima={"_before": F.when(F.col("_first_promoted").isNotNull(), F.col(time))},
        bucket=BUCKET if cuts else None,
        exclusive=True,
    )
    found = join_on(decisions, carried.drop(BUCKET), [*by, time], "left")
    same_time = F.col("_first_promoted") < F.col(tie_break)
    last = F.when(same_time, F.col(time)).otherwise(F.col("_before"))
    return found.withColumn("last_promotion", last).drop("_first_promoted", "_before")


def cooldown(rows: DataFrame, days: int = 7, now: str = "timestamp") -> DataFrame:
    """Whole days since ``last_promotion``, whether the cooldown is over, and the message."""
    since = whole_days("last_promotion", now)
    passed = F.col("last_promotion").isNull() | (since >= days)
    message = (
        F.when(F.col("last_promotion").isNull(), "never promoted before")
        .when(
            since < days,
            F.format_string(
                "promoted %d days ago; %d days of cooldown left", since, F.lit(days) - since
            ),
        )
        .otherwise(F.format_string("cooldown over, %d days after the last promotion", since))
    )
    return rows.withColumns({"days_since_promotion": since, "cooldown_passed": passed, "cooldown_message": message})


def segment_regression(
    segments: DataFrame, by: Sequence[str] = (), max_drop_pct: float = 5.0, model: str = "model"
) -> DataFrame:
    """Compare segment F1 of ``production`` and ``shadow`` rows: regressed, and missing in the challenger
    (listed, not blocking). Both sides come from one grouped pass instead of a self-join.
    """
    keys = [*by, "segment_feature", "segment"]
    sides = segments.groupBy(*keys).agg(
        F.max(F.when(F.col(model) == "production", F.col("f1_score"))).alias("prod_f1"),
        F.max(F.when(F.col(model) == "shadow", F.col("f1_score"))).alias("shadow_f1"),
    )
    change = F.when(F.col("prod_f1") > 0, (F.col("shadow_f1") - F.col("prod_f1")) / F.col("prod_f1") * 100.0)
    return sides.filter("prod_f1 IS NOT NULL").withColumns(
        {
            "change_pct": change,
            "missing_in_shadow": F.col("shadow_f1").isNull(),
            "regressed": F.coalesce(change < -max_drop_pct, F.lit(False)),
        }
    )


def segment_issues(comparison: DataFrame, by: Sequence[str]) -> DataFrame:
    """Regressed and missing segments per candidate as sorted lists of short texts (one per segment)."""
    name = F.concat("segment_feature", F.lit("="), "segment")
    drop = F.format_string("%s: F1 dropped %.1f%%", name, F.abs("change_pct"))
    return comparison.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("regressed"), drop))).alias("segment_issues"),
        F.array_sort(F.collect_list(F.when(F.col("missing_in_shadow"), name))).alias("missing_segments"),
    )


def _judge(limits: GateLimits) -> list[tuple[str, Column, Column, str]]:
    """(gate, passed, reason when failed, code) in order. A missing input fails its gate."""
    samples, coverage = F.col("num_samples"), F.col("coverage_rate") * 100.0
    gain, brier, issues = F.col("f1_improvement_pct"), F.col("brier_change"), F.col("segment_issues")

    def text(value: Column, pattern: str) -> Column:
        return F.when(value.isNull(), "missing").otherwise(F.format_string(pattern, value))

    cover = F.coalesce(coverage >= limits.min_coverage_pct, F.lit(limits.min_coverage_pct <= 0))
    judged = [
        (
            GATES[0],
            F.coalesce(samples >= limits.min_samples, F.lit(False)),
            # Fixed value: callers look for these two words.
            F.concat(F.lit("Insufficient samples: "), text(samples, "%d"), F.lit(f" < {limits.min_samples}")),
            "insufficient_samples",
        ),
        (
            GATES[1],
            cover,
            F.concat(
                F.lit("label coverage too low: "), text(coverage, "%.1f%%"), F.lit(f" < {limits.min_coverage_pct}%")
            ),
            "insufficient_coverage",
        ),
        (GATES[2], F.col("cooldown_passed"), F.col("cooldown_message"), "promotion_cooldown"),
        (
            GATES[3],
            F.coalesce(gain >= limits.min_f1_improvement_pct, F.lit(False)),
            F.concat(
                F.lit("F1 gain too small: "), text(gain, "%.2f%%"), F.lit(f" < {limits.min_f1_improvement_pct}%")
            ),
            "insufficient_improvement",
        ),
        (
            GATES[4],
            F.coalesce(brier <= limits.max_brier_degradation, F.lit(False)),
            F.concat(
                F.lit("calibration got worse, Brier by "), text(brier, "%.4f"),
                F.lit(f" > {limits.max_brier_degradation}"),
            ),
            "calibration_degraded",
        ),
        (
            GATES[5],
            F.coalesce(F.size(issues) == 0, F.lit(True)),
            F.concat(F.lit("segments got worse: "), F.coalesce(F.array_join(issues, ", "), F.lit(""))),
            "segment_regression",
        ),
    ]
    for name, passed in limits.extra.items():
        judged.append((name, F.coalesce(passed, F.lit(False)), F.lit(f"Gate failed: {name}"), name))
    return judged


def gate_decision(candidates: DataFrame, limits: GateLimits | None = None, now: str = "timestamp") -> DataFrame:
    """Judge every candidate: all gate results, the first failing gate, the action and the reason.

    Needs num_samples, coverage_rate, last_promotion, f1_improvement_pct, brier_change, segment_issues and the
    decision time. ``gate_results`` is an array in gate order; a gate behind the first failure is not
    ``evaluated``.
    """
    limits = limits or GateLimits()
    judged = _judge(limits)
    names = [name for name, _, _, _ in judged]
    flags = [f"_gate{i}" for i in range(len(judged))]
    ready = cooldown(candidates, limits.cooldown_days, now)
    rows = ready.withColumns({flag: passed for flag, (_, passed, _, _) in zip(flags, judged)})
    # The first failing gate, as a chain of conditions on plain boolean columns.
    position = F.lit(len(judged))
    for i in reversed(range(len(judged))):
        position = F.when(~F.col(flags[i]), F.lit(i)).otherwise(position)
    rows = rows.withColumn("_first", position)

    def of_first(values: Sequence[Column | str]) -> Column:
        chain = None
        for i, value in enumerate(values):
            value = F.lit(value) if isinstance(value, str) else value
            hit = F.col("_first") == i
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        return chain

    results = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("gate"),
                (F.col("_first") >= i).alias("evaluated"),
                F.when(F.col("_first") >= i, F.col(flags[i])).alias("passed"),
            )
            for i, name in enumerate(names)
        ]
    )
    summary = F.format_string(
        "passed every gate: F1 by %.2f%%, Brier by %+.4f, all segments hold",
        F.col("f1_improvement_pct"),
        F.col("brier_change"),
    )
    promoted = F.col("_first") == len(judged)
    return rows.withColumns(
        {
            "gate_results": results,
            "action": F.when(promoted, "promote").otherwise("reject"),
            "failed_gate": of_first(names),
            "reason_code": of_first([code for _, _, _, code in judged]),
            "reason": F.coalesce(of_first([reason for _, _, reason, _ in judged]), summary),
        }
    ).drop("_first", *flags)


def gate_rows(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per candidate and gate."""
    return decisions.select(*keys, F.inline("gate_results"))


def first_deployment(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """Candidates of models without a production version are promoted without comparison."""
    current = versions.filter("stage = 'Production'").groupBy("model_name").agg(
        F.max("version").alias("production_version")
    )
    joined = candidates.join(current, "model_name", "left")
    first = F.col("production_version").isNull()
    return joined.withColumns(
        {
            "is_first_deployment": first,
            "first_action": F.when(first, "promote"),
            "first_reason": F.when(first, "no model in production yet"),
        }
    )


def drift_interpretation(rows: DataFrame) -> DataFrame:
    """A sentence on the drift context of a decision."""
    found = F.coalesce(F.col("drift_share") > 0, F.lit(False))
    text = F.format_string(
        "drift in the data set: share %.3f, %d features",
        F.col("drift_share"),
        F.col("num_drifted_features"),
    )
    return rows.withColumns(
        {
            "drift_seen": found,
            "drift_interpretation": F.when(found, text).otherwise("no drift seen"),
        }
    )
