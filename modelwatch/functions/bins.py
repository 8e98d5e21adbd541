"""Ten equal score bins over [0, 1] with the two edge conventions that the metrics need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

N_BINS = 10
# Interior edges as doubles (i * 0.1, so the third one is 0.30000000000000004).
INTERIOR_EDGES = [i * 0.1 for i in range(1, N_BINS)]


def _as_column(score: str | Column) -> Column:
    return F.col(score) if isinstance(score, str) else score


def left_closed_bin(score: str | Column) -> Column:
    """Bin 0..9 holding [edge, next edge); the last bin includes 1. NULL outside [0, 1]."""
    p = _as_column(score)
    passed = reduce(lambda a, b: a + b, [(p >= F.lit(e)).cast("int") for e in INTERIOR_EDGES])
    return F.when(p.between(F.lit(0.0), F.lit(1.0)), passed)


def right_closed_bin(score: str | Column) -> Column:
    """Bin 0..9 holding (edge, next edge]; the first bin includes 0."""
    p = _as_column(score)
    return reduce(lambda a, b: a + b, [(p > F.lit(e)).cast("int") for e in INTERIOR_EDGES])


def histogram_counts(score: str | Column) -> list[Column]:
    """Ten conditional counts that aggregate in one pass and merge by addition."""
    b = left_closed_bin(score)
    return [F.count(F.when(b == F.lit(i), True)).alias(f"bin_{i}") for i in range(N_BINS)]


def histogram_entropy(counts: list[Column]) -> Column:
    """Shannon entropy (natural log) of a histogram.

    Every bin's share gets 1e-10 added before the shares are normalised again; an empty histogram gives 0.
    """
    eps = F.lit(1e-10)
    arr = F.array(*[c.cast("double") for c in counts])
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    share = F.transform(arr, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)) + eps)
    mass = F.aggregate(share, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(F.transform(share, lambda x: -(x / mass) * F.ln(x / mass)), F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, F.lit(0.0)).otherwise(entropy)
