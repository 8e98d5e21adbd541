"""Exact order statistics by selection: no row is ranked, sorted or shuffled.

One scan sketches every column and gives a range of values that is sure to hold the wanted ranks. One more counts what lies below
the ranges and combines what lies inside to distinct values, and the ranks are read off their running counts. Any number of
columns shares the two scans. Where a range still holds too many rows, further scans narrow it first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sketch's ranks are off by at most one in so many.
ACCURACY = 4_000
#: Rows of one column that may be combined to distinct values in one group; above, the range is narrowed by another scan.
MOST_ROWS = 20_000_000
#: Values inside the ranges that a task holds before it combines them.
HELD_ROWS = 1_000_000
#: Points of a narrowing sketch.
POINTS = 128


@dataclass
class Selected:
    """Usable rows of a column, and per asked rank the value there and the number of rows below that value."""

    rows: int
    values: list[Any]
    below: list[int]


@dataclass
class _Range:
    rows: int
    ranks: list[int]
    low: Any
    high: Any
    inside: float


def usable(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, Column]:
    """The columns with NaN taken as missing."""
    probe = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
    real = [f.dataType.typeName() in ("double", "float") for f in probe.schema.fields]
    return {n: F.when(~F.isnan(c), c) if r else c for (n, c), r in zip(columns.items(), real, strict=True)}


def select_ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    share: float,
    ranks: Callable[[int], Sequence[int]],
    accuracy: int = ACCURACY,
    most_rows: int = MOST_ROWS,
) -> dict[str, Selected]:
    """The values at 0-based ``ranks`` (a function of a column's usable rows) of each column, all near the ``share`` of its rows.

    NULL and NaN are left out. A column without usable rows has none. Numeric columns of one type keep their type, mixed ones
    are compared as doubles. Reads ``df`` twice; more often only where ``4 / accuracy`` of the rows is above ``most_rows``.
    """
    names = list(columns)
    exprs = usable(df, columns)
    if len({df.select(c.alias("c")).schema["c"].dataType for c in exprs.values()}) > 1:
        exprs = {n: c.cast("double") for n, c in exprs.items()}
    margin = 2.0 / accuracy
    around = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
    sketched = [F.count(exprs[n]).alias(f"n{i}") for i, n in enumerate(names)]
    sketched += [F.percentile_approx(exprs[n], around, accuracy).alias(f"q{i}") for i, n in enumerate(names)]
    seen = df.agg(*sketched).first()
    ranges = {}
    for i, n in enumerate(names):
        if rows := seen[f"n{i}"]:
            wanted = [min(max(0, r), rows - 1) for r in ranks(rows)]
            ranges[n] = _Range(rows, wanted, *seen[f"q{i}"], 2 * margin * rows)
    while wide := [n for n in ranges if ranges[n].inside > most_rows and ranges[n].low != ranges[n].high]:
        _narrow(df, {n: exprs[n] for n in wide}, ranges, accuracy)
    found = _read_off(df, exprs, ranges)
    missed = [n for n in ranges if found[n] is None]
    if missed:  # a sketch that was off by more than it promises: take the whole column
        for n in missed:
            ranges[n].low = ranges[n].high = None
        found |= _read_off(df, exprs, {n: ranges[n] for n in missed})
    return {n: found.get(n) or Selected(0, [], []) for n in names}


def _narrow(df: DataFrame, exprs: Mapping[str, Column], ranges: dict[str, _Range], accuracy: int) -> None:
    """Count below and inside each range and sketch the inside; keep the stretch between two points around the ranks."""
    aggregates = []
    points = F.array(*[F.lit(k / POINTS) for k in range(POINTS + 1)])
    for i, (n, c) in enumerate(exprs.items()):
        r = ranges[n]
        inside = F.when((c >= F.lit(r.low)) & (c <= F.lit(r.high)), c)
        aggregates += [F.count_if(c < F.lit(r.low)).alias(f"b{i}"), F.count(inside).alias(f"n{i}")]
        aggregates.append(F.percentile_approx(inside, points, accuracy).alias(f"q{i}"))
    seen = df.agg(*aggregates).first()
    for i, n in enumerate(exprs):
        r, below, inside, at = ranges[n], seen[f"b{i}"], seen[f"n{i}"], seen[f"q{i}"]
        narrower = None
        if below <= min(r.ranks) and max(r.ranks) < below + inside:
            first, last = (min(r.ranks) - below) / inside, (max(r.ranks) - below) / inside
            slack = 2.0 / accuracy
            narrower = at[max(0, int((first - slack) * POINTS))], at[min(POINTS, int((last + slack) * POINTS) + 1)]
        if narrower in (None, (r.low, r.high)):
            r.inside = 0  # cannot be narrowed: few values, or the range is not right and is found so when it is read off
        else:
            (r.low, r.high), r.inside = narrower, inside * 4 / POINTS


def _read_off(df: DataFrame, exprs: Mapping[str, Column], ranges: Mapping[str, _Range]) -> dict[str, Selected | None]:
    """One scan: counts below the ranges, distinct values inside them with their counts, and from these the ranks."""
    names = list(ranges)
    if not names:
        return {}
    cells = df.select(*[exprs[n].alias(f"c{i}") for i, n in enumerate(names)])
    counts = inside_counts(cells, [(ranges[n].low, ranges[n].high) for n in names])
    counted = counts.groupBy("column", "value").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_first())
    upto = counted.withColumn("upto", F.sum("n").over(ordered))
    picks = [F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("below"), F.max("upto").alias("upto")]
    most = max(len(ranges[n].ranks) for n in names)
    for k in range(most):
        at = F.element_at(F.array(*[F.lit(ranges[n].ranks[min(k, len(ranges[n].ranks) - 1)]).cast("long") for n in names]), F.col("column") + 1)
        after = (F.col("upto") > at) & F.col("value").isNotNull()
        picks += [F.min(F.when(after, F.col("value"))).alias(f"v{k}"), F.min(F.when(after, F.col("upto") - F.col("n"))).alias(f"b{k}")]
    out: dict[str, Selected | None] = {}
    for row in upto.groupBy("column").agg(*picks).collect():  # one row per column
        n = names[row["column"]]
        r = ranges[n]
        whole = (row["below"] or 0) <= min(r.ranks) and row["upto"] > max(r.ranks)
        each = range(len(r.ranks))
        out[n] = Selected(r.rows, [row[f"v{k}"] for k in each], [row[f"b{k}"] for k in each]) if whole else None
    return {n: out.get(n) for n in names}


def inside_counts(cells: DataFrame, bounds: Sequence[tuple[Any, Any]]) -> DataFrame:
    """(column, value, n) of the values inside each column's bounds, and with a NULL value the number of those below; for numeric
    columns of one type without NaN. A column without bounds counts whole. Values may come more than once.

    Cells are counted a column at a time: one row for each cell costs many times the scan.
    """
    kind = cells.schema[0].dataType
    schema = T.StructType([T.StructField("column", T.IntegerType()), T.StructField("value", kind), T.StructField("n", T.LongType())])

    def run(batches):
        held: list[list[pa.Array]] = [[] for _ in bounds]
        below, n_held = [0] * len(bounds), 0
        limits = None

        def rows(i: int, values: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), values, n.cast(pa.int64())], names=schema.names)

        def flushed():
            for i, chunks in enumerate(held):
                if chunks:
                    found = pa.chunked_array(chunks).value_counts()
                    yield rows(i, found.field("values"), found.field("counts"))
                    chunks.clear()

        for batch in batches:
            limits = limits or [[None if x is None else pa.scalar(x, batch.column(0).type) for x in b] for b in bounds]
            for i, (low, high) in enumerate(limits):
                c = batch.column(i).drop_null()
                if high is not None:
                    c = c.filter(pc.less_equal(c, high))
                if low is not None:
                    inside = c.filter(pc.greater_equal(c, low))
                    below[i] += len(c) - len(inside)
                    c = inside
                if len(c):
                    held[i].append(c)
                    n_held += len(c)
            if n_held >= HELD_ROWS:
                yield from flushed()
                n_held = 0
        yield from flushed()
        for i, n in enumerate(below):
            if n:
                yield rows(i, pa.nulls(1, limits[i][0].type), pa.array([n]))

    return cells.mapInArrow(run, schema)


def exact_medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    """The exact median of each column, the mean of the middle two where they differ; None without values."""
    middle = lambda n: [(n - 1) // 2, n // 2]
    found = select_ranks(df, {c: F.col(f"`{c}`") for c in columns}, 0.5, middle, **options)
    return {c: None if not s.rows else float(s.values[0]) + (float(s.values[1]) - float(s.values[0])) * 0.5 for c, s in found.items()}


def from_rank(df: DataFrame, order: Sequence[Column], share: float, **options) -> DataFrame:
    """The rows from rank floor(n * ``share``) on, by numeric order columns that together are a total order.

    The first column's value at the rank is selected, then, among the rows that tie on it alone, the next column's, and so
    on; what is left is one filter over ``df``. NULL sorts first; there is no NaN. Rows that tie on all columns stay or go
    together: they stay.
    """
    rank, tied, keep, equal = None, df, F.lit(False), F.lit(True)
    for number in order:
        rows, known = tied.agg(F.count(F.lit(1)), F.count(number)).first()
        rank = int(rows * share) if rank is None else rank
        missing = rows - known
        if rank < missing:
            keep, equal, tied = keep | (equal & number.isNotNull()), equal & number.isNull(), tied.where(number.isNull())
            continue
        at = rank - missing
        if at >= known:
            return df.where(keep)
        found = select_ranks(tied, {"order": number}, at / max(1, known - 1), lambda _, at=at: [at], **options)["order"]
        value = F.lit(found.values[0])
        keep, equal, tied = keep | (equal & (number > value)), equal & (number == value), tied.where(number == value)
        rank = at - found.below[0]
        if rank == 0:
            break
    return df.where(keep | equal)
