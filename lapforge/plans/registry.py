"""Registered queries: a Spark callable per name and, where it exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under `name`, with its SQL twin."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, so sums taken in another order compare equal."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    # Adding zero turns a negative zero into zero.
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in doubles}) if doubles else df


def rounded_sql(views: str, inner: str, doubles: str, places: int = 6) -> str:
    """`inner` over `views` with the named double columns rounded as `rounded` does."""
    parts = ", ".join(f"round(CAST({c} AS DOUBLE), {places}) + 0 AS {c}" for c in doubles.split())
    return f"{views}SELECT * REPLACE ({parts}) FROM ({inner})"
