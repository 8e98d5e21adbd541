"""Exact ordered computations without a single-task window.

Empirical distributions, ROC curves, exact quantiles, row ranks and "last value before" all need a running
total over sorted rows. A window partitioned only by the group puts a whole group on one task. Here a group is
first cut into buckets along its order column:

1. ``plan_cuts`` looks at the data once with mergeable sketches and returns a short list of cut values per
   column (no cuts while the column has few distinct values - then the plain window is the cheaper plan);
2. the window runs inside (group, bucket);
3. bucket totals - one small row per (group, bucket) - give each bucket its starting offset.

Cuts only decide where work is split. Rows with equal values share a bucket, so results are exact whatever
the sketch returned. The cuts are plain numbers in the plan, so a recomputed stage sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 20_000
# The second pass looks at about this many rows per wanted cut; fewer rows make coarser, still valid cuts.
ROWS_PER_CUT = 2_000
BROADCAST_ROWS = 500_000
BUCKET = "_bucket"

Cuts = Mapping[str, Sequence[float]]


def plan_cuts(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    rows_per_bucket: int | None = None,
    distinct: bool = True,
) -> dict[str, list[float]]:
    """Interior cut values for each numeric column expression.

    ``distinct`` says that rows will be pre-aggregated to distinct values, so only those count towards the
    size of a bucket; otherwise every row does. Runs one small aggregation, and a second one (quantile
    sketches over a sample) only for the columns that need cutting. The sample decides where work is split,
    never what is computed. Brings back a few numbers per column.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    names = list(exprs)
    rows = F.count(F.lit(1))
    counts = [
        (F.approx_count_distinct(exprs[c]) if distinct else rows).alias(f"n{i}") for i, c in enumerate(names)
    ]
    sizes = df.agg(*counts, rows.alias("rows")).first()
    wanted = {c: min(MAX_BUCKETS, -(-int(sizes[i]) // rows_per_bucket)) for i, c in enumerate(names)}
    large = [c for c in names if wanted[c] > 1]
    cuts: dict[str, list[float]] = {c: [] for c in names}
    if large:
        probes = [
            F.percentile_approx(
                exprs[c].cast("double"),
                [k / wanted[c] for k in range(1, wanted[c])],
                max(10_000, 2 * wanted[c]),
            ).alias(f"q{i}")
            for i, c in enumerate(large)
        ]
        share = min(1.0, ROWS_PER_CUT * max(wanted[c] for c in large) / sizes["rows"])
        source = df if share > 0.5 else df.sample(share, seed=7)
        found = source.agg(*probes).first()
        for i, c in enumerate(large):
            cuts[c] = sorted({float(v) for v in (found[i] or [])})
    return cuts


def with_bucket(df: DataFrame, value: str | Column, cuts: Sequence[float], name: str = BUCKET) -> DataFrame:
    """Add the bucket number of a numeric value: how many cuts lie at or below it.

    NULL gets the lowest bucket and NaN the highest, which is where an ascending sort puts them.
    """
    value = F.col(value) if isinstance(value, str) else value
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    source = f"{name}_value"
    bucketizer = Bucketizer(splits=splits, inputCol=source, outputCol=name, handleInvalid="keep")
    out = bucketizer.transform(df.withColumn(source, value.cast("double")))
    return out.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1))).drop(source)


def bucket_bound(cuts: Sequence[float]) -> int:
    """The most buckets that cuts can make, with one for NULL and one for NaN."""
    return len(cuts) + 3


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps one copy of the keys.

    Keys that cannot be NULL are compared plainly, so an existing hash partitioning on them is kept.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        never_null = k == BUCKET or not (left.schema[k].nullable and right.schema[k].nullable)
        term = F.col(k) == F.col(f"_r_{k}") if never_null else F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, str | Column] | None = None,
    maxima: Mapping[str, str | Column] | None = None,
    totals: Mapping[str, str | Column] | None = None,
    next_value: Mapping[str, str] | None = None,
    bucket: str | None = BUCKET,
    exclusive: bool = False,
    offset_rows: int | None = None,
) -> DataFrame:
    """Add running sums, running maxima, group totals and next values in sorted order.

    ``df`` has a bucket column that grows with the first order column (see ``with_bucket``); ``bucket=None``
    states that every group is small enough for one task. ``exclusive`` leaves the current row out of sums
    and maxima. ``totals`` adds the whole group's sum to every row. ``next_value`` maps an output name to the
    column whose following value (in order) is wanted. ``offset_rows`` is the caller's bound on the number of
    (group, bucket) pairs, where there is one: a small offset table is then broadcast, otherwise the
    optimizer chooses the join from its run-time size.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    sums = {k: as_col(v) for k, v in (sums or {}).items()}
    maxima = {k: as_col(v) for k, v in (maxima or {}).items()}
    totals = {k: as_col(v) for k, v in (totals or {}).items()}
    next_value = dict(next_value or {})
    order = [as_col(o) for o in order]
    inside_keys = [*groups, bucket] if bucket else list(groups)
    inside = Window.partitionBy(*inside_keys).orderBy(*order)
    upto = -1 if exclusive else Window.currentRow
    frame = inside.rowsBetween(Window.unboundedPreceding, upto)

    local: dict[str, Column] = {}
    for name, col in sums.items():
        local[name] = F.coalesce(F.sum(col).over(frame), F.lit(0))
    for name, col in maxima.items():
        local[name] = F.max(col).over(frame)
    for name, source in next_value.items():
        local[name] = F.lead(source).over(inside)
    if not bucket:
        whole = Window.partitionBy(*groups)
        for name, col in totals.items():
            local[name] = F.sum(col).over(whole)
        return df.withColumns(local)

    aggs = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    aggs += [F.max(c).alias(f"_m_{n}") for n, c in maxima.items()]
    aggs += [F.sum(c).alias(f"_t_{n}") for n, c in totals.items()]
    first = order[0] if len(order) == 1 else F.struct(*order)
    aggs += [F.min_by(s, first).alias(f"_n_{n}") for n, s in next_value.items()]
    per_bucket = df.groupBy(*inside_keys).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    across = Window.partitionBy(*groups).orderBy(bucket)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = per_bucket.select(
        *inside_keys,
        *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(before).alias(f"_p_{n}") for n in maxima],
        *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals],
        *[F.lead(f"_n_{n}").over(across).alias(f"_e_{n}") for n in next_value],
    )
    if offset_rows is not None and offset_rows <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    joined = join_on(df.withColumns(local), offsets, inside_keys)
    final: dict[str, Column] = {}
    for name in sums:
        final[name] = F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0))
    for name in maxima:
        final[name] = F.greatest(F.col(name), F.col(f"_p_{name}"))
    for name in next_value:
        final[name] = F.coalesce(F.col(name), F.col(f"_e_{name}"))
    spent = [f"_o_{n}" for n in sums] + [f"_p_{n}" for n in maxima] + [f"_e_{n}" for n in next_value]
    return joined.withColumns(final).drop(*spent)


def previous_values(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    bucket: str | None = BUCKET,
) -> DataFrame:
    """Add the preceding row's values (output name -> source column) in sorted order."""
    inside_keys = [*groups, bucket] if bucket else list(groups)
    inside = Window.partitionBy(*inside_keys).orderBy(*order)
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    out = df.withColumn("_prev", F.lag(packed).over(inside))
    if bucket:
        last = df.groupBy(*inside_keys).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
        across = Window.partitionBy(*groups).orderBy(bucket)
        edges = last.select(*inside_keys, F.lag("_last").over(across).alias("_edge"))
        out = join_on(out, edges, inside_keys).withColumn("_prev", F.coalesce("_prev", "_edge")).drop("_edge")
    return out.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in columns])


def numeric_form(df: DataFrame, name: str) -> Column:
    """A number that grows with a column's sort order: the value itself, microseconds, days, or the first six bytes of a text.

    Values that share the number share a bucket, so cuts on it never change a result.
    """
    c, kind = F.col(name), df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.unix_date(c)
    if kind == "boolean":
        return c.cast("int")
    if kind in ("string", "binary", "char", "varchar"):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("bigint")
    if isinstance(df.schema[name].dataType, T.NumericType):
        return c
    raise TypeError(f"rows cannot be cut along {name}, which is {kind}")


def row_ranks(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    numbers: Sequence[Column] | None = None,
    name: str = "rank",
    total: str | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add the exact 0-based rank of each row in its group; ``order`` (one or two columns) is a total order.

    ``numbers`` are numeric forms of the order columns to cut on; without them ``numeric_form`` gives them. On large inputs
    the rank is the count of rows with a smaller first column, from pre-aggregated counts, plus the rank
    among the rows that tie on it, which is cut on the second column: one hot order value is split as well.
    """
    one = F.lit(1).cast("bigint")
    totals = {total: one} if total else None
    numbers = list(numbers) if numbers else [numeric_form(df, c) for c in order]
    keys = [f"_k{i}" for i in range(len(order))]
    cuts = plan_cuts(df, dict(zip(keys, numbers)), rows_per_bucket, distinct=False)
    if not any(cuts.values()):
        ranked = running_totals(df, groups, order, sums={name: one}, totals=totals, bucket=None)
        return ranked.withColumn(name, F.col(name) - 1)
    head = order[0]
    heads = with_bucket(df, numbers[0], cuts[keys[0]]).groupBy(*groups, BUCKET, head)
    counted = heads.agg(F.count(F.lit(1)).alias("_n"))
    before = running_totals(
        counted,
        groups,
        [head],
        sums={"_before": "_n"},
        totals={total: "_n"} if total else None,
        exclusive=True,
        offset_rows=None if groups else bucket_bound(cuts[keys[0]]),
    ).drop(BUCKET, "_n")
    if len(order) == 1:
        return join_on(df, before, [*groups, head]).withColumnRenamed("_before", name)
    tied = with_bucket(df, numbers[1], cuts[keys[1]])
    tied = running_totals(tied, [*groups, head], order[1:], sums={"_among": one}).drop(BUCKET)
    joined = join_on(tied, before, [*groups, head])
    return joined.withColumn(name, F.col("_before") + F.col("_among") - 1).drop("_before", "_among")


def value_counts(df: DataFrame, groups: Sequence[str], value: str, cuts: Sequence[float]) -> DataFrame:
    """Distinct values with their counts; combined map-side, so a hot value is one row per task."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    keyed = with_bucket(clean, value, cuts) if cuts else clean
    keys = [*groups, BUCKET] if cuts else list(groups)
    return keyed.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks, one row per group.

    Without cuts the values are few enough for the built-in exact ``percentile``; with cuts the ranks come
    from bucketed running counts.
    """
    if not cuts:
        clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        return clean.groupBy(*groups).agg(*[F.percentile(value, q).alias(n) for n, q in probabilities.items()])
    counts = value_counts(df, groups, value, cuts)
    bound = None if groups else bucket_bound(cuts)
    ranked = running_totals(counts, groups, [value], sums={"_upto": "n"}, totals={"_all": "n"}, offset_rows=bound)
    picks, interpolated = quantile_picks(value, probabilities)
    return ranked.groupBy(*groups).agg(*picks).select(*groups, *[c.alias(n) for n, c in interpolated.items()])


def quantile_picks(value: str, probabilities: Mapping[str, float]) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over ranked distinct values (``_upto`` running count, ``_all`` total) and the interpolation
    between the two neighbouring values that they find."""
    picks, interpolated = [], {}
    for i, (name, q) in enumerate(probabilities.items()):
        position = F.lit(q) * (F.col("_all") - 1)
        picks.append(F.min(F.when(F.col("_upto") > F.floor(position), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value))).alias(f"_hi{i}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_fr{i}"))
        interpolated[name] = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")
    return picks, interpolated


def value_at_rank(df: DataFrame, value: str, rank: Column, cuts: Sequence[float], number: Column) -> DataFrame:
    """One row: the value at a 0-based rank (an expression over ``_all``, the row count), and that count."""
    keyed = with_bucket(df.filter(F.col(value).isNotNull()), number, cuts)
    counts = keyed.groupBy(BUCKET, value).agg(F.count(F.lit(1)).alias("n"))
    bucket = BUCKET if cuts else None
    ranked = running_totals(
        counts, [], [value], sums={"_upto": "n"}, totals={"_all": "n"}, bucket=bucket, offset_rows=bucket_bound(cuts)
    )
    return ranked.agg(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias("value"), F.max("_all").alias("n"))
