"""Vectors as integers, and exact sums over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest integer component: with it, 64-bit squared distances of up to 128 components cannot overflow.
LARGEST = 2**26


def integer_vectors(df: DataFrame, vec_col: str, dims: int, scale: int, **keep: Column) -> DataFrame:
    """Columns ``keep`` and ``v``, the vector's floor(scale * component), of rows with exactly ``dims`` finite components.

    Rows with a null vector, another length, or a null, NaN or infinite component are left out. A component beyond
    ``LARGEST`` cannot be squared into a long with the others: it ends the job with an error that says so.
    """
    x = F.col(f"`{vec_col}`").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    kept = df.select(*[c.alias(name) for name, c in keep.items()], x.alias("x"), (F.size(x) == dims).alias("sized"), odd.alias("odd"))
    kept = kept.where(F.col("sized") & ~F.coalesce("odd", F.lit(True)))
    too_large = F.exists("x", lambda e: F.abs(e * scale) >= LARGEST)
    floors = F.transform("x", lambda e: F.floor(e * scale).cast("long"))
    message = F.lit(f"a component times {scale} is beyond {LARGEST}: squared distances do not fit in 64 bits")
    return kept.select(*keep, F.when(too_large, F.raise_error(message)).otherwise(floors).alias("v"))


def matrix(column: pa.Array, width: int, dtype: type = np.int64) -> np.ndarray:
    """An array column without nulls, each array ``width`` long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def sums_by(labels: np.ndarray, n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of rows and integer column sums for each label below ``n``."""
    counts, sums = np.bincount(labels, minlength=n), np.zeros((n, values.shape[1]), np.int64)
    np.add.at(sums, labels, values)
    return counts, sums


def exact_means(partial: DataFrame, old: list[list[int]]) -> list[list[int]]:
    """New centres from tasks' (slot, n, sums): componentwise floor(sum / count); slots without rows keep ``old``.

    The driver gets one row per number of ``old``, whatever the number of rows. Totals are 38-digit decimals: no overflow.
    """
    parts = partial.select("slot", "n", F.posexplode("sums").alias("at", "value"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    new = [list(c) for c in old]
    for r in parts.groupBy("slot", "at").agg(exact("n"), exact("value")).collect():
        new[r["slot"]][r["at"]] = int(r["value"]) // int(r["n"])
    return new
