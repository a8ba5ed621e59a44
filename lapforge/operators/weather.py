"""Forecast rollups, weather classes and circuit factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import constants as k
from lapforge.functions.scalar import rain_probability
from lapforge.operators.groups import top_n
from lapforge.operators.history import difficulty, lookup


def daily_forecast(samples: DataFrame, keys: Sequence[str] = ("circuit_name",)) -> DataFrame:
    """Samples to one row per day: temperature range, means, rain and the usual condition."""
    return samples.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.min("temperature").alias("temp_min"),
        F.max("temperature").alias("temp_max"),
        F.avg("temperature").alias("temp_avg"),
        F.avg("humidity").alias("humidity_avg"),
        F.avg("wind_speed").alias("wind_speed_avg"),
        F.max(rain_probability(F.col("pop"))).alias("rain_probability_max"),
        F.sum(F.coalesce("rain_volume", F.lit(0.0))).alias("rain_volume_total"),
        F.mode("condition", True).alias("dominant_condition"),
    )


def weekend_days(daily: DataFrame, keys: Sequence[str] = ("circuit_name",)) -> DataFrame:
    """First day as practice, second as qualifying, third as race; needs all three."""
    days = top_n(daily, keys, [F.col("date")], 3, "__day")

    def of(day: int, col: str) -> Column:
        return F.max(F.when(F.col("__day") == day, F.col(col)))

    out = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__days"),
        of(1, "temp_avg").alias("practice_temperature"),
        of(1, "rain_probability_max").alias("practice_rain_probability"),
        of(2, "temp_avg").alias("qualifying_temperature"),
        of(2, "rain_probability_max").alias("qualifying_rain_probability"),
        of(3, "temp_avg").alias("race_temperature"),
        of(3, "temp_min").alias("race_temp_min"),
        of(3, "temp_max").alias("race_temp_max"),
        of(3, "rain_probability_max").alias("race_rain_probability"),
        of(3, "wind_speed_avg").alias("race_wind_speed"),
        of(3, "dominant_condition").alias("race_conditions"),
    )
    return out.filter(F.col("__days") == 3).drop("__days")


def weather_impact_class(temp: Column, rain: Column, sensitivity: Column) -> Column:
    """How the weather shapes a race; rain comes before heat."""
    return (
        F.when(rain > 60, "high_rain_impact")
        .when(rain > 30, "medium_rain_risk")
        .when(temp > 35, "extreme_heat")
        .when((temp > 30) & (F.coalesce(sensitivity, F.lit(0.5)) > 0.6), "high_heat_impact")
        .when(temp < 15, "cold_conditions")
        .otherwise("normal_conditions")
    )


def _notes(*cases: tuple[Column, list[str]]) -> Column:
    """The notes of the first case that holds, or none."""
    out = F.array().cast("array<string>")
    for condition, notes in reversed(cases):
        out = F.when(condition, F.array(*[F.lit(n) for n in notes])).otherwise(out)
    return out


def strategy_notes(temp: Column, rain: Column) -> Column:
    """Strategy notes for rain, then for temperature."""
    return F.concat(
        _notes((rain > 50, k.NOTES_WET), (rain > 20, k.NOTES_DAMP)),
        _notes((temp > 30, k.NOTES_HOT), (temp < 15, k.NOTES_COLD)),
    )


def advantage_notes(temp: Column, rain: Column) -> Column:
    """Who gains from rain and heat."""
    return F.concat(_notes((rain > 40, k.ADVANTAGE_WET)), _notes((temp > 30, k.ADVANTAGE_HOT)))


def fallback_climate(dim: DataFrame) -> DataFrame:
    """Typical temperature and rain chance for circuits without a forecast."""
    band = F.coalesce("temperature_range", F.array(F.lit(20.0), F.lit(25.0)))
    total = F.aggregate(band, F.lit(0.0), lambda a, x: a + x)
    return dim.withColumns(
        {
            "typical_temperature": total / 2,
            "typical_rain_probability": F.coalesce("rain_probability", F.lit(0.3)) * 100,
        }
    )


def circuit_factors(dim: DataFrame) -> DataFrame:
    """Difficulty factors of each circuit from its configuration."""
    kind = F.coalesce("circuit_type", F.lit("mixed"))
    hard = difficulty(F.col("overtaking_difficulty"))
    sensitivity = F.coalesce("weather_sensitivity", F.lit(0.5))

    def touchy(factor: Column) -> Column:
        hits = [F.contains(factor, F.lit(word)) for word in k.SETUP_FACTORS]
        return hits[0] | hits[1] | hits[2]

    count = F.coalesce(F.size(F.filter("key_factors", touchy)), F.lit(0))
    base = F.when(kind == "technical", 0.7).otherwise(0.5)
    return dim.withColumns(
        {
            "overtaking_rating": hard,
            "physical_demands": F.when(F.col("circuit_key").isin(k.HIGH_DEMAND), 0.9)
            .when(F.col("circuit_key").isin(k.MEDIUM_DEMAND), 0.6)
            .otherwise(0.4),
            "technical_complexity": lookup(kind, k.COMPLEXITY, 0.6),
            "strategy_importance": (hard + sensitivity) / 2,
            "driver_skill_factor": (lookup(kind, k.SKILL, 0.6) + hard) / 2,
            "car_setup_sensitivity": F.least(base + F.least(count * 0.1, F.lit(0.3)), F.lit(1.0)),
        }
    )
