"""Column functions: durations, lap-time text, labels and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(col: Column) -> Column:
    """Seconds of a day-time interval, to the millisecond."""
    part = lambda unit: F.extract(F.lit(unit), col).cast("decimal(18,6)")
    # Summed as decimals, so that rounding sees the exact microseconds.
    total = part("SECOND") + part("MINUTE") * 60 + part("HOUR") * 3600 + part("DAY") * 86400
    return F.round(total, 3).cast("double")


def format_lap_time(seconds: Column) -> Column:
    """Seconds as `m:ss.mmm`."""
    millis = F.round(seconds * 1000).cast("long")
    minutes = F.floor(millis / 60000)
    return F.format_string("%d:%06.3f", minutes, (millis - minutes * 60000) / 1000.0)


def parse_lap_time(text: Column) -> Column:
    """`m:ss.mmm` as seconds, NULL if it is not one."""
    parts = F.split(F.trim(text), ":")
    minutes = F.get(parts, F.lit(0)).try_cast("int")
    seconds = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, minutes * 60 + seconds)


def tier(position: Column) -> Column:
    """Performance tier of a constructor position."""
    return (
        F.when(position <= 2, "top_tier")
        .when(position <= 5, "upper_midfield")
        .when(position <= 7, "midfield")
        .otherwise("lower_tier")
    )


def ordinal(position: Column) -> Column:
    """Position with its English suffix, as in 1st, 12th, 23rd."""
    last, last2 = position % 10, position % 100
    suffix = (
        F.when(last2.between(11, 13), "th")
        .when(last == 1, "st")
        .when(last == 2, "nd")
        .when(last == 3, "rd")
        .otherwise("th")
    )
    return F.concat(position.cast("string"), suffix)


def percent(share: Column) -> Column:
    """Share as a percentage with one decimal."""
    return F.format_string("%.1f%%", F.round(share * 100, 1))


def round_output(col: Column, places: int) -> Column:
    """Round half up to `places`."""
    return F.round(col, places)


def rain_probability(pop: Column) -> Column:
    """Probability of precipitation in percent, 0 if missing."""
    return F.coalesce(pop, F.lit(0.0)) * 100
