"""Dataset profile and fingerprint.

A fingerprint is a commutative combination of row hashes: it does not depend on the order of rows, columns or
partitions, counts duplicates, and is computed in one map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_HEX = 15
#: What tells one state of a file from another.
FILE = ["file_path", "file_size", "file_modification_time"]
SCALE = float(1 << 62)


def canonical_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as text that no other row has: columns in name order, each with its name's and its value's length.

    Reals keep all their bits (-0 is 0), times are microseconds, NULL differs from every text.
    """
    parts = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in sorted(columns or df.columns):
        c, t = F.col(f"`{name}`"), types[name]
        if isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType):
            c = exact_real(c.cast("double"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp")).cast("string")
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        value = F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
        parts.append(F.concat(F.lit(f"{len(name)}:{name}="), value))
    return F.concat_ws(";", *parts)


def exact_real(x: Column) -> Column:
    """A double as text, its whole part and its rest in units of 2**-62; both are exact integers for all but extreme values.

    Values from 2**63 on, and those with bits below 2**-62, are written as the shortest decimal that reads back as the value.
    """
    whole = x.try_cast("bigint")
    rest = (x - whole.cast("double")) * F.lit(SCALE)
    units = rest.try_cast("bigint")
    return F.when(units.cast("double") == rest, F.concat_ws("_", whole, units)).otherwise(F.lower(x.cast("string")))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = True) -> Column:
    """A 60-bit row hash: from md5 (repeatable in any engine) or from xxhash64 (faster)."""
    if portable:
        return F.conv(F.substring(F.md5(canonical_text(df, columns)), 1, ROW_HEX), 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in sorted(columns or df.columns)]), 4)


def _halves(h: str = "_h") -> list[Column]:
    """Rows, xor, and the sums of the upper and lower 30 bits of row hashes: none overflows below 8e9 rows of one group, and
    the parts add up as decimals."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.shiftright(h, 30)).alias("_high"),
        F.sum(F.col(h).bitwiseAND(F.lit((1 << 30) - 1))).alias("_low"),
        F.bit_xor(h).alias("hash_xor"),
    ]


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = True) -> DataFrame:
    """One row: rows, sum and xor of the row hashes, and a digest of the three."""
    hashed = df.select(row_hash(df, columns, portable).alias("_h"), F.spark_partition_id().alias("_p"))
    return combine(hashed.groupBy("_p").agg(*_halves()))


def file_fingerprints(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = True) -> DataFrame:
    """One row per file that ``df`` reads: its path, size and time of change, and the part of the fingerprint its rows make.

    ``df`` is a plain read of files. Parts of any files add up with ``combine``, so a table of them answers for unchanged files.
    """
    meta = [F.col(f"_metadata.{c}").alias(c) for c in FILE]
    return df.select(*meta, row_hash(df, columns, portable).alias("_h")).groupBy(*FILE).agg(*_halves())


def combine(parts: DataFrame) -> DataFrame:
    """The fingerprint of all rows of some parts: sums add up, xors combine."""
    exact = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    total = (exact("_high") * F.lit(1 << 30).cast("decimal(10,0)") + exact("_low")).cast("decimal(38,0)")
    combined = parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), total.alias("_sum"), F.coalesce(F.bit_xor("hash_xor"), F.lit(0)).alias("hash_xor")
    )
    text = F.concat_ws("|", F.col("rows").cast("string"), F.col("_sum").cast("string"), F.col("hash_xor").cast("string"))
    return combined.select("rows", F.col("_sum").cast("string").alias("hash_sum"), "hash_xor", F.sha2(text, 256).alias("dataset_hash"))


def current_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of change of the Parquet files below ``path``, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(
        F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modification_time")
    )


def refreshed_parts(
    spark: SparkSession, path: str, known: DataFrame | None, columns: Sequence[str] | None = None, portable: bool = True, unit: Column | None = None
) -> tuple[DataFrame, int]:
    """Parts of all files below ``path``, and how many files had to be read for them.

    ``unit`` (of ``file_path``, the folder for instance) counts units instead: those to which no part that is kept belongs.

    Files whose path, size and time of change are in ``known`` (an earlier result, stored) keep their parts; only others are
    read. Parts of files that are gone are left out. Paths of files to read come to the driver, as they do for any read.
    """
    files = current_files(spark, path)
    if known is None:
        fresh, kept = files, None
    else:
        fresh, kept = files.join(known.select(*FILE), FILE, "left_anti"), known.join(files, FILE, "left_semi")
    paths = [r["file_path"] for r in fresh.select("file_path").collect()]
    if not paths:
        return known.where(F.lit(False)) if kept is None else kept, 0
    n_read = len(paths)
    if unit is not None:
        units = fresh.select(unit.alias("unit")).distinct()
        n_read = (units if kept is None else units.join(kept.select(unit.alias("unit")), "unit", "left_anti")).count()
    made = file_fingerprints(spark.read.parquet(*paths), columns, portable)
    return made if kept is None else kept.unionByName(made), n_read


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows.

    Duplicates are counted on whole rows; equal rows meet as one combined row per task, not as copies.
    """
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"), F.max(nulls).alias("_nulls"))
    return distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("dataset_rows"),
        F.lit(len(df.columns)).alias("dataset_columns"),
        F.coalesce(F.sum(F.col("_nulls") * F.col("_n")), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def matches(df: DataFrame, expected_hash: str, columns: Sequence[str] | None = None, portable: bool = True) -> bool:
    """Does the table still have this fingerprint?"""
    return fingerprint(df, columns, portable).first()["dataset_hash"] == expected_hash


def verify(df: DataFrame, expected_hash: str, columns: Sequence[str] | None = None, portable: bool = True) -> None:
    """Raise when the table was changed since the fingerprint was taken."""
    found = fingerprint(df, columns, portable).first()["dataset_hash"]
    if found != expected_hash:
        raise ValueError(f"reference integrity check failed: expected {expected_hash[:16]}, found {found[:16]}")
