"""Helpers shared by the text operators: batch mapping, word rules, hashing, and tables that cut lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.session import scratch_dir
from modelwatch.sources.commits import delete

ASCII_SPACE = b" \t\n\r\x0b\f"
#: Bytes of word characters stay (A-Z lower-cased), everything else below 0x80 becomes a space.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
ROWS_PER_CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared checkpoint folder and read it back.

    Cuts lineage: what is read later does not depend on executors that computed it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Most bytes and rows of one exchange with a Python worker where texts are long or lists many.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def stored_by_small_batches(df: DataFrame, purpose: str) -> DataFrame:
    """As ``stored``, with small batches to and from Python workers, so that neither side of an executor holds many texts at once,
    and with a compression that suits texts.

    The settings are the session's again afterwards.
    """
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in BATCH}
    try:
        for name, value in BATCH.items():
            conf.set(name, value)
        return stored(df, purpose, "zstd")
    finally:
        for name, value in before.items():
            conf.set(name, value)


def release(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once everything that reads them has been stored itself."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII digits and letters (A-Z lower-cased) and of all characters beyond ASCII."""
    return text.translate(ALNUM_TABLE).split()


def row_key(*names: str):
    """128-bit key of a row's content, as two longs; equal rows share it."""
    columns = [F.col(f"`{n}`") for n in names]
    return F.struct(
        F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(len(names)), *columns[::-1]).alias("b")
    )


def packed(df: DataFrame, **more) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, whatever their names, beside the columns given here."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[c.alias(name) for name, c in more.items()])


def unpacked(row: str, names: Sequence[str], **changed) -> list:
    """The columns of a struct again, some of them replaced."""
    return [changed[n].alias(n) if n in changed else F.col(row)[n].alias(n) for n in names]


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text_col: str,
    fn: Callable[[list], Sequence],
    fields: str,
    chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Columns ``keep`` plus what ``fn`` derives from a chunk of texts (bytes or None), chunk by chunk.

    ``fn`` returns one sequence per column of ``fields`` (DDL), each as long as the chunk.
    """
    added = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], *added.fields])
    n_keep, names = len(keep), schema.names
    kinds = arrow_types(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, chunk):
                part = batch.slice(low, chunk)
                made = fn(part.column(n_keep).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *arrays], names=names)

    return source.mapInArrow(run, schema)


def arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of distinct words."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, from the words' hashes; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    k_used = min(k, n)
    out = np.full(n - k_used + 1, k_used, np.uint64)
    for j in range(k_used):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)])
    return out


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
