"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

NUDGE = 1e-9

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement over the same tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, so that engines agree on the last digits.

    Means of decimal values often end in an exact half at the last place, where the order of summation
    decides; the nudge puts such halves on one side. It also removes negative zero.
    """
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "double":
            c = F.round(c + F.lit(NUDGE), places).alias(field.name)
        out.append(c)
    return df.select(*out)
