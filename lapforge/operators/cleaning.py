"""Staging: type repair, filters, renames, deduplication and distinct sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.constants import CIRCUIT_ALIASES
from lapforge.operators.groups import top_n

STAGING_NAMES = {"year": "season_year", "round": "round_number", "season": "season_year"}
EVENT = ["season_year", "round_number", "circuit_name"]


def _finite(col: str, kind: T.DataType) -> Column:
    value = F.col(col)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        infinite = F.abs(value) == float("inf")
        return F.when(~F.isnan(value) & ~infinite, value)
    return value


def sanitize(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Repair columns to `schema`: NaN, infinite and unparseable values become NULL.

    Fractions going into integer columns are cut off, numbers going into booleans are
    true unless zero. Columns outside the schema pass through.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    fixed = {}
    for field in schema.fields:
        if field.name not in have:
            continue
        kind, target = have[field.name], field.dataType
        value = _finite(field.name, kind)
        if isinstance(target, (T.IntegerType, T.LongType)):
            if isinstance(kind, T.StringType):
                # Whole numbers only, as text such as "7.9" is not an integer.
                value = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value))
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                value = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
            value = value.try_cast(target)
        elif isinstance(target, T.BooleanType) and isinstance(kind, T.NumericType):
            value = value != 0
        elif kind != target:
            value = value.try_cast(target)
            if isinstance(target, T.DoubleType):
                value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        fixed[field.name] = value
    return df.withColumns(fixed)


def stamp(df: DataFrame, col: str = "ingested_at", at: Column | None = None) -> DataFrame:
    """Fill `col` with `at` (default: now) where it is missing."""
    at = F.current_timestamp() if at is None else at
    return df.withColumn(col, F.coalesce(F.col(col), at) if col in df.columns else at)


def valid_laps(df: DataFrame) -> DataFrame:
    """Laps with a driver, a positive time and a lap number."""
    return df.filter(
        (F.coalesce(F.col("driver_code"), F.lit("")) != "")
        & (F.col("lap_time_seconds") > 0)
        & F.col("lap_number").isNotNull()
    )


def race_laps(df: DataFrame, session: str = "RACE") -> DataFrame:
    """Timed laps of one session type."""
    return df.filter((F.col("session_type") == session) & F.col("lap_time_seconds").isNotNull())


def filter_active(df: DataFrame, roster: DataFrame, key: str = "driver_code") -> DataFrame:
    """Rows whose driver is on the roster."""
    return df.join(roster.select(key), key, "left_semi")


def filter_absent(df: DataFrame, others: DataFrame, key: str = "driver_code") -> DataFrame:
    """Rows whose key does not occur in `others`."""
    return df.join(others.select(key), key, "left_anti")


def where_eq(df: DataFrame, **params) -> DataFrame:
    """Equality on each named column; values are bound, never spliced into text."""
    for name, value in params.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def exclude_aliases(df: DataFrame, col: str, names: Sequence[str] = tuple(CIRCUIT_ALIASES)) -> DataFrame:
    """Drop rows under a legacy name, ignoring case."""
    return df.filter(~F.lower(col).isin([n.lower() for n in names]))


def where_like(df: DataFrame, col: str, text: str) -> DataFrame:
    """Rows whose column contains `text`, ignoring case."""
    return df.filter(F.contains(F.lower(col), F.lit(text.lower())))


def to_staging(df: DataFrame, names: Mapping[str, str] = STAGING_NAMES) -> DataFrame:
    """Rename raw columns to staging names."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def null_sentinels(df: DataFrame, cols: Sequence[str], sentinel: int = 99) -> DataFrame:
    """Turn the no-result marker into NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def numeric_positions(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose position is a whole number, as an integer."""
    text = F.trim(F.col(col).cast("string"))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("int")
    return df.withColumn(col, number).filter(F.col(col).isNotNull())


def min_sample(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows backed by at least `n` samples."""
    return df.filter(F.col(col) >= n)


def select_seasons(
    df: DataFrame, year: int | None = None, backfill: bool = False, col: str = "season_year"
) -> DataFrame:
    """One season, or all of them for a backfill."""
    return df if backfill or year is None else df.filter(F.col(col) == year)


def valid_coordinates(dim: DataFrame, col: str = "coordinates") -> DataFrame:
    """Add `coordinates_valid`: a latitude and a longitude within range."""
    lat, lon = F.try_element_at(col, F.lit(1)), F.try_element_at(col, F.lit(2))
    ok = (F.size(col) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return dim.withColumn("coordinates_valid", F.coalesce(ok, F.lit(False)))


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the newest row per key; copies are dropped before the shuffle too."""
    return top_n(df, keys, order, 1)


def canonical(col: str, names: Mapping[str, str] = CIRCUIT_ALIASES) -> Column:
    """The canonical name for a legacy alias, anything else unchanged."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(col)), F.col(col))


def distinct_names(df: DataFrame, col: str, aliases: Mapping[str, str] = CIRCUIT_ALIASES) -> DataFrame:
    """Distinct names after alias normalization."""
    return df.filter(F.col(col).isNotNull()).select(canonical(col, aliases).alias(col)).distinct()


def event_keys(df: DataFrame, keys: Sequence[str] = EVENT) -> DataFrame:
    """Distinct reload units of a batch."""
    return df.select(*keys).distinct()
