"""Joins that bring results, standings, grid, sessions and teammates together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.asof import before
from lapforge.operators.groups import contains_join, top_n

RACE = ["season_year", "round_number"]


def scaffold(roster: DataFrame, facts: DataFrame, defaults: Mapping[str, object], keys: Sequence[str] = ("driver_code",)) -> DataFrame:
    """Every roster row with its facts, or the defaults where there are none."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    return roster.join(facts, list(keys), "left").withColumns(filled)


def with_standings(df: DataFrame, standings: DataFrame, teams: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add championship position, points, team and team rank, with last-place defaults.

    `by` names what tells championships apart, such as the season that the tables apply to.
    """
    by = list(by)
    table = standings.select(
        *by,
        "driver_code",
        F.col("position").alias("championship_position"),
        F.col("points").alias("championship_points"),
        F.col("team").alias("current_team"),
    )
    rank = teams.select(*by, F.col("team").alias("current_team"), "team_rank")
    filled = {
        "championship_position": F.coalesce("championship_position", F.lit(20)),
        "championship_points": F.coalesce("championship_points", F.lit(0.0)),
        "current_team": F.coalesce("current_team", F.lit("Unknown")),
        "team_rank": F.coalesce("team_rank", F.lit(10)),
    }
    joined = df.join(table, [*by, "driver_code"], "left").join(rank, [*by, "current_team"], "left")
    return joined.withColumns(filled)


def driver_weekend(results: DataFrame, quali: DataFrame, summaries: DataFrame, sessions: Sequence[str]) -> DataFrame:
    """Race rows with qualifying and, per session, the lap summary in prefixed columns."""
    keys = [*RACE, "driver_code"]
    measures = ["total_laps", "valid_laps", "fastest_lap", "average_lap", "consistency"]
    wide = summaries.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("session_type") == s, F.col(m))).alias(f"{s.lower()}_{m}")
            for s in sessions
            for m in measures
        ]
    )
    return results.join(quali, keys, "left").join(wide, keys, "left")


def with_grid(
    df: DataFrame, grid: DataFrame, keys: Sequence[str] = RACE, substring: bool = False
) -> DataFrame:
    """Add `grid_position` from weekend qualifying rows (`driver`, `position`).

    Drivers are matched by equal code, or with `substring` by either text containing
    the other, ignoring case; the best position wins if several match.
    """
    slots = grid.select(*keys, F.upper("driver").alias("__driver"), F.col("position").alias("grid_position"))
    coded = df.withColumn("__code", F.upper("driver_code"))
    if not substring:
        best = slots.groupBy(*keys, "__driver").agg(F.min("grid_position").alias("grid_position"))
        return coded.join(best.withColumnRenamed("__driver", "__code"), [*keys, "__code"], "left").drop("__code")
    pairs = contains_join(coded.select(*keys, "__code").distinct(), slots, "__code", "__driver", keys)
    best = pairs.groupBy(*keys, "__code").agg(F.min("grid_position").alias("grid_position"))
    return coded.join(best, [*keys, "__code"], "left").drop("__code")


def combine_scores(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "score",
                   weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Weighted sum of two score tables; a missing right score adds nothing."""
    mixed = F.col(left) * weights[0] + F.coalesce(F.col(right), F.lit(0.0)) * weights[1]
    return a.join(b.select(*keys, right), list(keys), "left").withColumn(name, mixed)


def _other(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the first other driver of the group, from its two first codes; no pairs are formed."""
    pair = (
        top_n(df.select(*keys, "driver_code").distinct(), keys, [F.col("driver_code")], 2, "__r")
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("__r") == 1, F.col("driver_code"))).alias("__first"),
            F.max(F.when(F.col("__r") == 2, F.col("driver_code"))).alias("__second"),
        )
    )
    other = F.when(F.col("driver_code") == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    return df.join(pair, list(keys), "left").withColumn(name, other).drop("__first", "__second")


def teammate(drivers: DataFrame, standings: DataFrame, results: DataFrame, roster: DataFrame) -> DataFrame:
    """Add `teammate` and where it was found.

    First the standings, then the latest race in which someone else drove for the same
    team, then the roster. Among several, the lowest driver code is taken.
    """
    current = _other(standings.select("team", "driver_code"), ["team"], "__t1").select("driver_code", "__t1")
    raced = _other(results.select(*RACE, "team", "driver_code"), [*RACE, "team"], "__t2")
    latest = top_n(
        raced.filter(F.col("__t2").isNotNull()), ["driver_code"], [F.col(c).desc() for c in RACE], 1
    ).select("driver_code", "__t2")
    listed = _other(roster.select("team", "driver_code"), ["team"], "__t3").select("driver_code", "__t3")
    source = (
        F.when(F.col("__t1").isNotNull(), "standings")
        .when(F.col("__t2").isNotNull(), "results")
        .when(F.col("__t3").isNotNull(), "roster")
    )
    return (
        drivers.join(current, "driver_code", "left")
        .join(latest, "driver_code", "left")
        .join(listed, "driver_code", "left")
        .withColumns({"teammate": F.coalesce("__t1", "__t2", "__t3"), "teammate_source": source})
        .drop("__t1", "__t2", "__t3")
    )


def teammate_by_season(drivers: DataFrame, standings: DataFrame, results: DataFrame, roster: DataFrame) -> DataFrame:
    """`teammate` for every (season, driver) of `drivers`, from what was known before the season.

    `standings` has the season that a table applies to; the latest race shared with someone is
    looked for in earlier seasons, by a running maximum over them.
    """
    key = ["season_year", "driver_code"]
    current = _other(standings.select("season_year", "team", "driver_code"), ["season_year", "team"], "__t1")
    raced = _other(results.select(*RACE, "team", "driver_code"), [*RACE, "team"], "__t2")
    shared = F.struct("season_year", "round_number", F.col("__t2").alias("mate"))
    latest = before(
        drivers, raced.filter(F.col("__t2").isNotNull()), ["driver_code"], {"__latest": ("max", shared)}
    ).select(*key, F.col("__latest.mate").alias("__t2"))
    listed = _other(roster.select("team", "driver_code"), ["team"], "__t3").select("driver_code", "__t3")
    source = (
        F.when(F.col("__t1").isNotNull(), "standings")
        .when(F.col("__t2").isNotNull(), "results")
        .when(F.col("__t3").isNotNull(), "roster")
    )
    return (
        drivers.join(current.select(*key, "__t1"), key, "left")
        .join(latest, key, "left")
        .join(listed, "driver_code", "left")
        .withColumns({"teammate": F.coalesce("__t1", "__t2", "__t3"), "teammate_source": source})
        .drop("__t1", "__t2", "__t3")
    )


def judged(predictions: DataFrame, actual: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Per race: was the winner predicted first, in the top 3, in the top 5, and at which rank.

    `predictions` has `rank` and `driver_code`, `actual` has `winner`. Only the first
    ten predictions are looked at.
    """
    won = actual.select(*keys, F.col("winner").alias("driver_code"))
    ranked = predictions.filter(F.col("rank") <= 10).select(*keys, "driver_code", "rank")
    found = won.join(ranked, [*keys, "driver_code"], "left")
    known = F.col("driver_code").isNotNull()

    def within(n: int) -> Column:
        return known & F.coalesce(F.col("rank") <= n, F.lit(False))

    return found.select(
        *keys,
        F.col("driver_code").alias("winner"),
        F.col("rank").alias("predicted_rank"),
        within(1).alias("winner_predicted"),
        within(3).alias("top_3"),
        within(5).alias("top_5"),
    )


def evaluate(predictions: DataFrame, actual: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Hit rates over all races."""
    rows = judged(predictions, actual, keys)
    return rows.agg(
        F.count(F.lit(1)).alias("races"),
        F.avg(F.col("winner_predicted").cast("int")).alias("winner_accuracy"),
        F.avg(F.col("top_3").cast("int")).alias("top_3_accuracy"),
        F.avg(F.col("top_5").cast("int")).alias("top_5_accuracy"),
        F.avg("predicted_rank").alias("mean_predicted_rank"),
    )
