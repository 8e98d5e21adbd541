"""The end of a retraining round: version table, decision row and record change together, or not at all.

A round writes new folders and then one commit that names them. Readers see the state before or after, never a version table without
its decision; a round that was decided on an older state is turned away and leaves nothing.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators import registry
from modelwatch.operators.validate import check_unique, one_production_per_model, require_valid
from modelwatch.sources import commits

#: Folders of decisions and records that are joined to one when there are so many.
MOST_FOLDERS = 100
TABLES = ("versions", "decisions", "records")


def read_round(spark: SparkSession, root: str, at: commits.Version | None = None) -> dict[str, DataFrame]:
    """The tables of the newest round (or of ``at``); a table that no round has written is missing."""
    state = (at or commits.latest(spark, root)).state
    return {name: spark.read.parquet(*[f"{root}/{name}/{f}" for f in state[name]]) for name in TABLES if state.get(name)}


def publish_round(
    spark: SparkSession,
    root: str,
    expected: commits.Version,
    versions: DataFrame,
    decision: DataFrame | None = None,
    record: DataFrame | None = None,
) -> commits.Version:
    """Publish the new version table with the round's decision rows and records, as the successor of ``expected``.

    A version table with two production versions of a model or a repeated version is refused before anything is published.
    ``StaleVersion`` means that another round was published meanwhile; what this one wrote is removed again.
    """
    require_valid(one_production_per_model(versions).unionByName(check_unique(versions, registry.VERSION_KEY)))
    folder = f"round-{expected.number + 1:09d}-{uuid.uuid4().hex}"
    state, written = dict(expected.state), []
    for name, rows in zip(TABLES, (versions, decision, record), strict=True):
        if rows is None:
            continue
        earlier = [] if name == "versions" else state.get(name, [])
        if len(earlier) >= MOST_FOLDERS:
            rows, earlier = rows.unionByName(read_round(spark, root, expected)[name]), []
        rows.write.parquet(f"{root}/{name}/{folder}")
        written.append(f"{root}/{name}/{folder}")
        state[name] = [*earlier, folder]
    try:
        return commits.commit(spark, root, expected, state)
    except commits.StaleVersion:
        for path in written:
            commits.delete(spark, path)
        raise


def finish_round(
    spark: SparkSession, root: str, expected: commits.Version, decision: DataFrame, candidates: DataFrame, at: str | datetime | Column
) -> commits.Version:
    """Bring decisions into effect on the state they were made on, and publish both.

    ``candidates`` holds the challengers' version rows. A ``promote`` puts its challenger into production and archives what was
    there, a ``reject`` archives the challenger, any other action leaves the table as it is. Each decision leaves one record.
    """
    before = read_round(spark, root, expected)["versions"]
    acted = decision.select("model_name", F.col("shadow_model_version").alias("version"), "action")
    chosen = lambda action: acted.where(F.col("action") == action).select("model_name", "version").distinct()
    judged = candidates.join(acted.where(F.col("action").isin("promote", "reject")), ["model_name", "version"], "left_semi")
    known = registry.upsert_versions(before, judged)
    after = registry.reject(registry.promote(known, chosen("promote"), at), chosen("reject"), at)
    records = registry.transition_records(known, chosen("promote"), at, "promote")
    records = records.unionByName(registry.transition_records(known, chosen("reject"), at, "reject"))
    return publish_round(spark, root, expected, after, decision, records)
