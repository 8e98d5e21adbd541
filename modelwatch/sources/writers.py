"""Sinks: append-only logs, run and decision tables, snapshots, JSON records.

Snapshots are written to a new path, never over the path they were read from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.operators.cleaning import canonical_log
from modelwatch.operators.fingerprint import fingerprint
from modelwatch.operators.perturb import reference_metadata
from modelwatch.operators.registry import upsert_versions
from modelwatch.operators.validate import check_unique, one_production_per_model, require_valid


def append_predictions(df: DataFrame, path: str, features: Sequence[str], time: str = "timestamp") -> None:
    """Append scored rows in the canonical column order, partitioned by day."""
    rows = canonical_log(df, features, time=time).withColumn("day", F.to_date(time))
    rows.write.mode("append").partitionBy("day").parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Bulk append."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_new(df: DataFrame, existing: DataFrame | None, path: str, keys: Sequence[str] = ("timestamp",)) -> None:
    """Append only rows whose key is not there yet (runs and decisions have one row per key)."""
    rows = df.dropDuplicates(list(keys))
    if existing is not None:
        rows = rows.join(existing.select(*keys), list(keys), "left_anti")
    rows.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, unique: Sequence[str] = ()) -> None:
    """Write a new snapshot of a keyed table after checking its key."""
    if unique:
        require_valid(check_unique(df, unique))
    df.write.mode("errorifexists").parquet(path)


def publish_versions(current: DataFrame, updates: DataFrame, path: str) -> None:
    """Upsert model versions into a new snapshot; a second production version of a model stops the write."""
    merged = upsert_versions(current, updates)
    require_valid(one_production_per_model(merged).unionByName(check_unique(merged, ["model_name", "version"])))
    merged.write.mode("errorifexists").parquet(path)


def write_reference(reference: DataFrame, folder: str, created_at: str, source: str = "training_test_split") -> None:
    """Freeze a reference once: rows, then one metadata row with the fingerprint of what was written."""
    reference.write.mode("errorifexists").parquet(f"{folder}/reference_data")
    stored = reference.sparkSession.read.parquet(f"{folder}/reference_data")
    digest = F.lit(fingerprint(stored).first()["dataset_hash"])
    meta = reference_metadata(stored, digest, F.lit(created_at), source)
    meta.write.mode("errorifexists").json(f"{folder}/reference_metadata")


def write_records(df: DataFrame, folder: str) -> None:
    """Append JSON records (decisions, perturbation events, drift summaries)."""
    df.write.mode("append").json(folder)


def write_summary(document: DataFrame, folder: str, stamp: str) -> None:
    """Write one drift summary document into its own folder, named by time like the stored files."""
    document.coalesce(1).write.mode("errorifexists").json(f"{folder}/drift_summary_{stamp}.json")


def write_importance(importance: DataFrame, path: str) -> None:
    """Write the importance table, most important first. It has one row per feature."""
    importance.orderBy(F.col("importance").desc(), "feature").coalesce(1).write.mode("overwrite").option(
        "header", "true"
    ).csv(path)
