"""Start and drain streaming queries on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# For large state (late-label joins, deduplication over long watermarks) keep state off the JVM heap.
LARGE_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, glob: str | None = None
) -> DataFrame:
    """A stream of Parquet files with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


#: Key of rows that only move the watermark.
END = "<end of stream>"


def with_end_marker(stream: DataFrame, path: str, time: str, at: str, key: str = "prediction_id") -> DataFrame:
    """``stream`` and one more row below ``path``: ``time`` is ``at``, ``key`` is ``END``, all other columns are null.

    Once it has been read, the watermark stands past everything before, so windows close and joined rows leave their state with
    no further input. Take ``at`` beyond the last time plus delays and bounds, and drop rows of this key from what the sink has got:
    a filter in the stream may be moved below the watermark (which is also why the key is not null: joins filter nulls early).
    """
    spark = stream.sparkSession
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields])
    known = {time: F.lit(at), key: F.lit(END)}
    row = spark.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    row.coalesce(1).write.mode("overwrite").parquet(path)
    return stream.unionByName(file_stream(spark, path, kind))


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append to a Parquet table with the file sink's exactly-once commit log; runs over what is there, then ends."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.format("parquet").trigger(availableNow=True).start()


def each_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a batch function per micro-batch; it must be repeatable for the same batch id."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(fn).trigger(availableNow=True).start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own folder, replacing an earlier attempt of the same batch."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table a drained stream wrote; empty when it wrote nothing."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except Exception as error:  # a sink that never got a batch has no folder
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def drain(query: StreamingQuery) -> None:
    """Wait until all available input is processed; a failure is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
