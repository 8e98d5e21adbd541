"""Column names, imputation, casts and clamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.operators.selection import exact_medians
from modelwatch.tables import FEATURES

# Allowed range per monitored feature.
FEATURE_BOUNDS: dict[str, tuple[float, float]] = {
    "RevolvingUtilizationOfUnsecuredLines": (0.0, 1.0),
    "age": (18, 100),
    "NumberOfTime30_59DaysPastDueNotWorse": (0, 10),
    "DebtRatio": (0.0, 5.0),
    "MonthlyIncome": (0.0, 1_000_000),
    "NumberOfOpenCreditLinesAndLoans": (0, 50),
    "NumberOfTimes90DaysLate": (0, 10),
    "NumberRealEstateLoansOrLines": (0, 10),
    "NumberOfTime60_89DaysPastDueNotWorse": (0, 10),
    "NumberOfDependents": (0, 10),
}


def normalise_names(df: DataFrame, required: Sequence[str] = FEATURES) -> DataFrame:
    """Rename hyphenated columns to underscores and fail on a required column that is still missing."""
    renamed = df.withColumnsRenamed({c: c.replace("-", "_") for c in df.columns if "-" in c})
    missing = [c for c in required if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return renamed


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(drop)]


def numeric_only(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Numeric columns without the listed ones (index, target)."""
    return df.select(*numeric_columns(df, drop))


def project_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only the monitored features, in order; a missing one is an error before any job runs."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*features)


def medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    """The exact median of each column, None without values; two scans for any number of columns."""
    return exact_medians(df, columns, **options)


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Fill NULL and NaN with the column's exact median; ``options`` go to the selection."""
    columns = list(columns or numeric_columns(df))
    found = medians(df, columns, **options)

    def fill(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.lit(found[c]).cast("double")).otherwise(value)

    return df.withColumns({c: fill(c) for c in columns})


def clamp(
    value: str | Column, low: float | None = None, high: float | None = None, default: float = 0.0, to: str = "double"
) -> Column:
    """Cast (never failing), replace bad values (NULL, NaN, infinite) by the default, then apply the bounds."""
    number = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    kept = number if to == "double" else F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")
    if low is not None:
        kept = F.greatest(kept, F.lit(float(low)))
    if high is not None:
        kept = F.least(kept, F.lit(float(high)))
    return F.when(bad, F.lit(float(default))).otherwise(kept).cast(to)


def clamp_table(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]] = FEATURE_BOUNDS, integers: Sequence[str] = ()
) -> DataFrame:
    """Clamp every column of a bounds table."""
    whole = set(integers)
    return df.withColumns(
        {c: clamp(c, lo, hi, to="bigint" if c in whole else "double") for c, (lo, hi) in bounds.items()}
    )


def canonical_log(
    df: DataFrame, features: Sequence[str], fallback_id: bool = True, time: str = "timestamp"
) -> DataFrame:
    """Scored rows in the log's column order; ``application_date`` defaults to the scoring time.

    A missing id becomes a content hash, which is stable when a task is retried (a random one is not).
    """
    keys = ["prediction_id", time, "model_version", "prediction", "probability"]
    missing = [c for c in [*keys[1:], *features] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df
    if "application_date" not in df.columns:
        out = out.withColumn("application_date", F.lit(None).cast(df.schema[time].dataType))
    if "prediction_id" not in df.columns:
        out = out.withColumn("prediction_id", F.lit(None).cast("string"))
    content = F.concat(F.lit("pred_"), F.substring(F.sha2(F.to_json(F.struct(*keys[1:], *features)), 256), 1, 32))
    ident = F.coalesce(F.col("prediction_id"), content) if fallback_id else F.col("prediction_id")
    return out.select(
        ident.alias("prediction_id"),
        *keys[1:],
        F.coalesce("application_date", time).alias("application_date"),
        *features,
    )


def time_based_id(time: str | Column) -> Column:
    """The readable id form; collides for rows scored in the same microsecond."""
    at = F.col(time) if isinstance(time, str) else time
    return F.concat(F.lit("pred_"), F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"))
