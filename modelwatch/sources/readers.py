"""Scans with explicit schemas: logs, labels, references, summaries, decision and perturbation records."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.functions.times import instant, interval
from modelwatch.operators.fingerprint import verify
from modelwatch.tables import (
    DECISION_RECORD,
    DRIFT_SUMMARY,
    FEATURE_SCHEMA,
    LABEL_STORE,
    PERTURBATION_EVENT,
    PERTURBATION_LOG,
    PREDICTION_LOG,
    REFERENCE_METADATA,
    TARGET,
)

CORRUPT = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def read_table(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """A table in any of Spark's file formats with a declared schema. CSV keeps unparsable lines aside."""
    reader = spark.read.format(form)
    if form == "csv":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("header", "true").option("mode", "PERMISSIVE")
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).load(path)


def read_predictions(
    spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType = PREDICTION_LOG
) -> DataFrame:
    """The prediction log. For CSV use ``split_corrupt`` to separate the bad lines."""
    return read_table(spark, path, schema, form)


def read_labels(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return read_table(spark, path, LABEL_STORE, form)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines). Nothing is discarded.

    A line is bad when it has the wrong number of fields or a value of the wrong type; a header in another
    column order shows up the same way, because its data lines do not fit the declared types.
    """
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    return good, bad


def header_issues(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_LOG) -> DataFrame:
    """Files of a CSV folder whose first line is not the declared column list.

    Only the first block of each file takes part, and the first line is found map-side.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    numbered = lines.filter("start = 0").withColumn("line", F.monotonically_increasing_id())
    headers = numbered.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    names = ",".join(schema.names)
    return headers.filter(F.col("header") != names).withColumn("expected", F.lit(names))


def read_reference(spark: SparkSession, folder: str, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frozen reference rows, one metadata row); a missing reference is an error."""
    rows_path, meta_path = f"{folder}/reference_data", f"{folder}/reference_metadata"
    if not _exists(spark, rows_path):
        raise FileNotFoundError(f"reference data not found at {rows_path}; freeze a reference first")
    rows = spark.read.parquet(rows_path)
    meta = spark.read.schema(REFERENCE_METADATA).json(meta_path)
    if check:
        verify(rows, meta.first()["reference_hash"])
    return rows, meta


# Fixed value: how a stored summary's file name carries its time.
SUMMARY_NAME = r"drift_summary_(\d{8})[^0-9](\d{6})\.json"


def read_summaries(
    spark: SparkSession, folder: str, now: str | datetime | Column | None = None, lookback_hours: int = 24
) -> DataFrame | None:
    """Stored drift summaries with ``report_time`` from the file name, newest first; None without a folder.

    Files with an unreadable name or body are left out.
    """
    if not _exists(spark, folder):
        return None
    schema = T.StructType([*DRIFT_SUMMARY.fields, T.StructField(CORRUPT, T.StringType())])
    docs = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true")
        .json(folder)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    digits = F.concat(F.regexp_extract("_file", SUMMARY_NAME, 1), F.regexp_extract("_file", SUMMARY_NAME, 2))
    timed = docs.withColumn("report_time", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))
    usable = timed.filter(F.col(CORRUPT).isNull() & F.col("report_time").isNotNull())
    if now is not None:
        usable = usable.filter(F.col("report_time") >= instant(now) - interval(lookback_hours, "HOUR"))
    return usable.drop(CORRUPT, "_file").orderBy(F.col("report_time").desc())


def read_decision_records(spark: SparkSession, folder: str, documents: bool = False) -> DataFrame:
    """Decision records of every kind under one schema; ``at`` is the parsed time.

    Records are JSON lines as ``write_records`` leaves them, or with ``documents`` one formatted document per
    file.
    """
    docs = spark.read.schema(DECISION_RECORD).option("multiLine", str(documents).lower()).json(folder)
    return docs.withColumn("at", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))


def deployment_history(records: DataFrame, limit: int = 10) -> DataFrame:
    """Newest decision records first (a top-k report)."""
    return records.orderBy(F.col("at").desc(), "action").limit(limit)


def read_perturbations(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """One row per perturbation event, from JSON lines or, with ``documents``, from a document with an event array."""
    if documents:
        events = spark.read.schema(PERTURBATION_LOG).option("multiLine", "true").json(path)
        events = events.select(F.inline("drift_events"))
    else:
        events = spark.read.schema(PERTURBATION_EVENT).json(path)
    return events.withColumn("at", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))


def recent_perturbations(events: DataFrame, now: str | datetime | Column, hours: int) -> DataFrame:
    """Events not older than the given hours."""
    return events.filter(F.col("at") >= instant(now) - interval(hours, "HOUR"))


def read_training_csv(spark: SparkSession, path: str, index: str = "_c0") -> DataFrame:
    """Raw training rows: index, target and features, with the column names as they are in the file.

    The header is used for names (hyphens included), the types are declared.
    """
    header = spark.read.option("header", "true").csv(path).columns
    kinds = {f.name: f.dataType for f in FEATURE_SCHEMA.fields}
    kinds[TARGET] = T.IntegerType()
    fields = [
        T.StructField(c, kinds.get(c.replace("-", "_"), T.DoubleType() if c != index else T.LongType())) for c in header
    ]
    for f in fields:
        if isinstance(f.dataType, T.LongType) and f.name != index:
            f.dataType = T.DoubleType()
    return spark.read.option("header", "true").option("nullValue", "NA").schema(T.StructType(fields)).csv(path)


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], **parameters) -> DataFrame:
    """A parameterised statement over named tables: values are bound, not pasted."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=parameters)
