"""Model versions and decisions: stage changes, current versions, history reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.times import instant, interval, micros
from modelwatch.operators.ordered import BUCKET, plan_cuts, running_totals, with_bucket

VERSION_KEY = ["model_name", "version"]
# Columns that an existing version takes over from an update; all others keep their first value.
UPDATABLE = ["stage", "promoted_at", "archived_at", "updated_at"]


def upsert_versions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """New snapshot of the version table: unknown versions are inserted, known ones change stage and times.

    An update without a promotion or archive time keeps the stored one.
    """
    fresh = updates.select(*[c for c in updates.columns if c in current.columns])
    tagged = [c for c in fresh.columns if c not in VERSION_KEY]
    renamed = fresh.select(*VERSION_KEY, F.lit(True).alias("_upd"), *[F.col(c).alias(f"_u_{c}") for c in tagged])
    stored = current.withColumn("_old", F.lit(True))
    joined = stored.join(renamed, VERSION_KEY, "full_outer")

    def merged(c: str) -> Column:
        if c in VERSION_KEY or c not in tagged:
            return F.col(c)
        new, old = F.col(f"_u_{c}"), F.col(c)
        if c in UPDATABLE:
            return F.coalesce(new, old).alias(c)
        return F.when(F.col("_old"), old).otherwise(new).alias(c)

    return joined.select(*[merged(c) for c in current.columns])


def promote(versions: DataFrame, promotions: DataFrame, at: str | datetime | Column) -> DataFrame:
    """Move one version per model to Production and archive the one that was there.

    ``promotions`` has (model_name, version), at most one row per model.
    """
    return _transition(versions, promotions, at, "Production", archive_current=True)


def reject(versions: DataFrame, rejections: DataFrame, at: str | datetime | Column) -> DataFrame:
    """Archive the rejected challenger versions."""
    return _transition(versions, rejections, at, "Archived", archive_current=False)


def rollback(versions: DataFrame, targets: DataFrame, at: str | datetime | Column) -> DataFrame:
    """Restore an earlier version per model to Production and archive the current one."""
    return _transition(versions, targets, at, "Production", archive_current=True)


def _transition(
    versions: DataFrame, targets: DataFrame, at: str | datetime | Column, stage: str, archive_current: bool
) -> DataFrame:
    # A target that is not in the table changes nothing; transition_records reports it as failed.
    known = targets.join(versions.select(*VERSION_KEY), VERSION_KEY, "left_semi")
    wanted = known.select("model_name", F.col("version").alias("_target")).distinct()
    joined = versions.join(wanted, "model_name", "left") if archive_current else versions.join(
        wanted.withColumnsRenamed({"_target": "version"}).withColumn("_target", F.col("version")), VERSION_KEY, "left"
    )
    hit = F.col("version") == F.col("_target")
    leaves = F.lit(archive_current) & F.col("_target").isNotNull() & ~hit & (F.col("stage") == "Production")
    when = instant(at)
    archived = leaves | (hit & F.lit(stage == "Archived"))
    return joined.select(
        *[
            {
                "stage": F.when(hit, stage).when(leaves, "Archived").otherwise(F.col("stage")),
                "promoted_at": F.when(hit & F.lit(stage == "Production"), when).otherwise(F.col("promoted_at")),
                "archived_at": F.when(archived, when)
                .when(hit, F.lit(None))
                .otherwise(F.col("archived_at")),
                "updated_at": F.when(hit | leaves, when).otherwise(F.col("updated_at")),
            }.get(c, F.col(c)).alias(c)
            for c in versions.columns
        ]
    )


def transition_records(versions: DataFrame, targets: DataFrame, at: str | datetime | Column, action: str) -> DataFrame:
    """One audit record per target: what moved, what it replaced, or a failure when the version is unknown."""
    known = versions.select(*VERSION_KEY, F.lit(True).alias("_known"))
    current = versions.filter("stage = 'Production'").select("model_name", F.col("version").alias("_current"))
    out = targets.join(known, VERSION_KEY, "left").join(current, "model_name", "left")
    ok = F.col("_known").isNotNull()
    return out.select(
        instant(at).alias("timestamp"),
        F.when(ok, action).otherwise(f"{action}_failed").alias("action"),
        "model_name",
        "version",
        F.when(ok & (F.lit(action) != "reject"), F.col("_current")).alias("previous_production_version"),
        F.when(ok & (F.lit(action) == "reject"), "successful_rejection").alias("outcome"),
        F.when(~ok, "version not found").alias("error"),
    )


def latest_per_stage(versions: DataFrame, stages: Sequence[str] | None = None) -> DataFrame:
    """The highest version of each model and stage."""
    rows = versions.filter(F.col("stage").isin(list(stages))) if stages else versions
    rest = [c for c in versions.columns if c not in ("model_name", "stage")]
    best = rows.groupBy("model_name", "stage").agg(F.max_by(F.struct(*rest), "version").alias("_best"))
    return best.select("model_name", "stage", "_best.*")


def rollback_candidates(versions: DataFrame) -> DataFrame:
    """Archived versions, lowest first."""
    return versions.filter("stage = 'Archived'").orderBy("model_name", "version")


def model_timeline(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Versions with the drift and action of the decision that made them, newest version first."""
    context = decisions.select(
        F.col("id").alias("decision_id"), F.col("feature_drift_ratio").alias("drift_at_training"), "action"
    )
    out = versions.join(context, "decision_id", "left")
    columns = ["model_name", "version", "stage", "trained_at", "promoted_at", "f1_score", "drift_at_training", "action"]
    return out.select(*columns).orderBy(F.col("version").desc(), "model_name")


def recent_monitoring(runs: DataFrame, limit: int = 100, tie_break: str = "model_version") -> DataFrame:
    """The newest ``limit`` monitoring runs (a top-k report)."""
    picked = runs.orderBy(F.col("timestamp").desc(), tie_break).limit(limit)
    return picked.select(
        "timestamp", tie_break, "num_predictions", "feature_drift_ratio", "dataset_drift_detected", "positive_rate",
        "entropy",
    )


def trend(
    runs: DataFrame, now: str | datetime | Column, days: int = 7, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Drift columns of the runs of the last days, in time order."""
    keys = list(dict.fromkeys(["timestamp", *order]))
    return (
        runs.filter(F.col("timestamp") > instant(now) - interval(days, "DAY"))
        .select(*keys, "feature_drift_ratio", "dataset_drift_detected", "num_drifted_features")
        .orderBy(*order)
    )


def decision_history(decisions: DataFrame, limit: int = 50, tie_break: str = "id") -> DataFrame:
    """Newest decisions first (a top-k report)."""
    return decisions.orderBy(F.col("timestamp").desc(), F.col(tie_break).desc()).limit(limit)


def count_by_action(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def rejection_rate(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rejections over rejections plus promotions; NULL without either."""
    counted = decisions.groupBy(*by).agg(
        F.count(F.when(F.col("action") == "reject", True)).alias("rejected"),
        F.count(F.when(F.col("action") == "promote", True)).alias("promoted"),
    )
    return counted.withColumn("rejection_rate", F.try_divide("rejected", F.col("rejected") + F.col("promoted")))


def production_at(
    rows: DataFrame, versions: DataFrame, time: str = "timestamp", rows_per_bucket: int | None = None
) -> DataFrame:
    """Which version of the row's model was in Production at the row's time.

    As-of lookup without a range join: promotion times and the rows' distinct times are merged in time order
    per model and the last promotion is carried forward (cut along time, so a model with a long history is
    spread over tasks). Rows then pick up their version by an equi-join on model and time. From the time at which
    that version was archived there is none, unless another was promoted.
    """
    asked = rows.filter(F.col(time).isNotNull()).select("model_name", F.col(time).alias("_at")).distinct()
    starts = versions.filter("promoted_at IS NOT NULL").groupBy("model_name", F.col("promoted_at").alias("_at")).agg(
        F.max(F.struct(F.col("version").cast("int").alias("_version"), F.col("archived_at").alias("_until"))).alias("_start")
    )
    starts = starts.select("model_name", "_at", "_start._version", "_start._until")
    both = asked.withColumns({"_version": F.lit(None).cast("int"), "_until": F.lit(None).cast(starts.schema["_until"].dataType)})
    both = both.unionByName(starts)
    moments = both.groupBy("model_name", "_at").agg(F.max("_version").alias("_version"), F.max("_until").alias("_until"))
    cuts = plan_cuts(both, {"t": micros("_at")}, rows_per_bucket, distinct=True)["t"]
    start = F.when(F.col("_version").isNotNull(), F.struct("_at", "_version", "_until"))
    carried = running_totals(
        with_bucket(moments, micros("_at"), cuts),
        ["model_name"],
        ["_at"],
        maxima={"_last": start},
        bucket=BUCKET if cuts else None,
    )
    until = F.col("_last._until")
    left = until.isNotNull() & (until > F.col("_last._at")) & (until <= F.col("_at"))
    known = carried.select(
        "model_name", F.col("_at").alias(time), F.when(~left, F.col("_last._version")).alias("production_version")
    )
    return rows.join(known, ["model_name", time], "left").select(*rows.columns, "production_version")
