"""A keyed table kept current from a stream: copy on write by key bucket, published by numbered commits.

Rows are dealt into buckets by a hash of their key. A micro-batch rewrites only the buckets it touches, into a folder of its own;
one commit then points to the new folder for those buckets and to the old ones for the rest. Readers see whole batches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from modelwatch.operators.labels import keep_last
from modelwatch.sources import commits
from modelwatch.streaming.jobs import each_batch

BUCKET = "_bucket"


def _newest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``, then by all other columns, so the order of arrival does not matter."""
    rest = [f.name for f in df.schema.fields if f.name not in {key, *order} and f.dataType.typeName() != "map"]
    return keep_last(df, [key], [*order, *rest])


def read_snapshot(
    spark: SparkSession, path: str, buckets: Sequence[int] | None = None, at: commits.Version | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The table as of the newest commit (or of ``at``); only some buckets if asked for.

    Where nothing has been committed it is empty, with the columns of ``schema``.
    """
    state = (at or commits.latest(spark, path)).state
    kind = T.StructType.fromJson(state["schema"]) if state else schema or T.StructType()
    where = state.get("buckets", {})
    chosen = sorted(where, key=int) if buckets is None else [str(b) for b in buckets if str(b) in where]
    if not chosen:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{path}/data/{where[b]}/{BUCKET}={b}" for b in chosen])


def merge_batch(
    updates: DataFrame,
    path: str,
    batch_id: int,
    key: str,
    order: Sequence[str],
    source: str = "stream",
    n_buckets: int = 64,
    keep_versions: int = 10,
) -> commits.Version:
    """Fold one micro-batch into the table and publish it; returns the version that holds it.

    The last row per key by ``order`` wins, whether it is stored already or comes now, so batches may come late, twice or in any
    order. A batch of ``source`` that is not newer than the last one committed is a replay and changes nothing. Rows with a
    null key are left out. The number of buckets is fixed with the first batch; it bounds the number of folders and what one
    task rewrites. Folders that no kept version names are deleted, failed attempts included.
    """
    spark = updates.sparkSession
    current = commits.latest(spark, path)
    state = current.state
    if state.get("sources", {}).get(source, -1) >= batch_id:
        return current
    if state and state["n_buckets"] != n_buckets:
        raise ValueError(f"{path} has {state['n_buckets']} buckets, not {n_buckets}")
    kind = T.StructType.fromJson(state["schema"]) if state else updates.schema
    bucket = F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")
    rows = updates.select(*kind.names).where(F.col(key).isNotNull())
    fresh = _newest(rows, key, order).withColumn(BUCKET, bucket).persist()
    try:
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())  # n_buckets at most
        folder = f"{source}-{batch_id:09d}-{uuid.uuid4().hex}"
        if touched:
            stored = read_snapshot(spark, path, touched, current, kind).withColumn(BUCKET, bucket)
            merged = _newest(stored.unionByName(fresh), key, order)
            merged.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{folder}")
    finally:
        fresh.unpersist()
    new = {
        "schema": json.loads(kind.json()),
        "n_buckets": n_buckets,
        "sources": {**state.get("sources", {}), source: batch_id},
        "buckets": {**state.get("buckets", {}), **{str(b): folder for b in touched}},
    }
    made = commits.commit(spark, path, current, new)
    compact(spark, path, keep_versions, source, batch_id)
    return made


def compact(spark: SparkSession, path: str, keep_versions: int, source: str, batch_id: int) -> None:
    """Forget all versions but the newest, and delete folders that none of these names: those of forgotten versions, and what
    failed attempts of ``source`` left, up to its batch ``batch_id``. What other sources are writing is not touched."""
    forgotten, left = commits.forget(spark, path, keep_versions)
    named = {f for v in left for f in v.state["buckets"].values()}
    spent = {f for v in forgotten for f in v.state["buckets"].values()}
    for folder in commits.folders(spark, f"{path}/data"):
        owner, number, _ = folder.rsplit("-", 2)
        if folder not in named and (folder in spent or (owner == source and int(number) <= batch_id)):
            commits.delete(spark, f"{path}/data/{folder}")


def label_snapshot(
    stream: DataFrame, path: str, checkpoint: str, key: str = "prediction_id", order: Sequence[str] = ("updated_at",), **options
) -> StreamingQuery:
    """Keep the latest label per id from a stream of labels, without stream state: the table itself is the state."""
    return each_batch(stream, lambda batch, i: merge_batch(batch, path, i, key, order, **options), checkpoint)
