"""History analytics over classified results, per circuit unless other keys are given.

Unknown positions are NULL; a driver without a finish did not finish. Spread here is
the population deviation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.constants import DIFFICULTY, DIFFICULTY_DEFAULT
from lapforge.operators.asof import before
from lapforge.operators.groups import top_n
from lapforge.operators.marts import consistency, count_where, ratio

RACE = ["season_year", "round_number"]
BY = ("circuit_name",)


def _f() -> Column:
    return F.col("finish_position")


def _g() -> Column:
    return F.col("grid_position")


def winners(results: DataFrame) -> DataFrame:
    return results.filter(_f() == 1)


def lookup(col: Column, table: dict[str, float], default: float) -> Column:
    """Value of a word in a fixed table, else the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(col, F.lit(""))), F.lit(default))


def difficulty(col: Column) -> Column:
    """Overtaking difficulty word to 0.2..1.0."""
    return lookup(col, DIFFICULTY, DIFFICULTY_DEFAULT)


def winners_by_year(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    return winners(results).select(*keys, *RACE, "driver_code", "team", "grid_position")


def wins_by(results: DataFrame, col: str, keys: Sequence[str] = BY) -> DataFrame:
    """Wins per driver or team."""
    return winners(results).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("wins"))


def winner_patterns(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Mean grid slot of winners, pole and front-row win rates over winners with a known slot."""
    known = F.count(_g())
    return winners(results).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("races_won"),
        F.avg(_g()).alias("avg_winning_grid"),
        ratio(count_where(_g() == 1), known).alias("pole_win_rate"),
        ratio(count_where(_g() <= 2), known).alias("front_row_win_rate"),
    )


def correlation(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; 0 where it is undefined."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def with_circuit(df: DataFrame, dim: DataFrame, key: str = "circuit_name") -> DataFrame:
    """Add circuit attributes, with defaults where the dimension has none.

    `configured_importance` is the importance as configured, NULL if it is not.
    """
    attributes = dim.select(
        key,
        F.col("qualifying_importance").alias("__q"),
        F.col("overtaking_difficulty").alias("__d"),
        F.col("circuit_type").alias("__t"),
        F.col("weather_sensitivity").alias("__w"),
    )
    defaults = {
        "configured_importance": F.col("__q"),
        "qualifying_importance": F.coalesce("__q", F.lit(0.7)),
        "overtaking_difficulty": F.coalesce("__d", F.lit("medium")),
        "circuit_type": F.coalesce("__t", F.lit("mixed")),
        "weather_sensitivity": F.coalesce("__w", F.lit(0.5)),
    }
    return df.join(attributes, key, "left").withColumns(defaults).drop("__q", "__d", "__t", "__w")


def qualifying_impact(results: DataFrame, dim: DataFrame) -> DataFrame:
    """How much the grid decides: rates over races with a winner, correlation over all classified."""
    won = count_where(_f() == 1)
    stats = results.groupBy("circuit_name").agg(
        ratio(count_where((_f() == 1) & (_g() == 1)), won).alias("pole_to_win_rate"),
        ratio(count_where((_f() == 1) & (_g() <= 2)), won).alias("front_row_advantage"),
        correlation(_g(), _f()).alias("position_correlation"),
    )
    history = (F.col("pole_to_win_rate") + F.col("front_row_advantage")) / 2
    score = (F.col("qualifying_importance") + history) / 2
    out = with_circuit(stats, dim).withColumn("qualifying_importance_score", score)
    return out.select(*stats.columns, "qualifying_importance_score")


def races(results: DataFrame) -> DataFrame:
    """One row per race with its winner, NULL if nobody is classified first."""
    won = F.max(F.when(_f() == 1, F.col("driver_code")))
    return results.groupBy(*RACE, "circuit_name").agg(won.alias("winner"))


def _weathered(results: DataFrame, weather: DataFrame) -> DataFrame:
    sky = weather.select(*RACE, "air_temp_avg", "rainfall", F.lit(True).alias("__known"))
    return races(results).join(sky, RACE, "left")


def weather_impact(results: DataFrame, weather: DataFrame) -> DataFrame:
    """Wet races and temperature bands per circuit; the wet share is over all races."""
    temp = F.col("air_temp_avg")
    wet = F.coalesce(F.col("rainfall"), F.lit(False))
    return _weathered(results, weather).groupBy("circuit_name").agg(
        F.count(F.lit(1)).alias("races"),
        count_where(wet).alias("wet_races"),
        (count_where(wet) / F.count(F.lit(1))).alias("wet_race_share"),
        count_where(temp > 30).alias("hot_races"),
        count_where(temp < 15).alias("cold_races"),
        count_where((temp >= 15) & (temp <= 30)).alias("moderate_races"),
    )


def rain_winners(results: DataFrame, weather: DataFrame) -> DataFrame:
    """Wins in wet races per circuit and driver."""
    wet = _weathered(results, weather).filter(F.col("rainfall") & F.col("winner").isNotNull())
    return wet.groupBy("circuit_name", F.col("winner").alias("driver_code")).agg(
        F.count(F.lit(1)).alias("wet_wins")
    )


def team_performance(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Wins, podiums, points finishes, entries, mean finish and consistency per team."""
    return results.groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("total_entries"),
        count_where(_f() == 1).alias("wins"),
        count_where(_f() <= 3).alias("podiums"),
        count_where(_f() <= 10).alias("points_finishes"),
        F.avg(_f()).alias("avg_position"),
        F.when(F.count(_f()) > 0, consistency(F.stddev_pop(_f()))).alias("consistency_score"),
    )


def specialists(results: DataFrame, min_appearances: int = 3, keys: Sequence[str] = BY) -> DataFrame:
    """Drivers seen often enough at a circuit, with finish and grid records."""
    stats = results.groupBy(*keys, "driver_code").agg(
        F.count(F.lit(1)).alias("appearances"),
        F.avg(_f()).alias("avg_position"),
        F.min(_f()).alias("best_finish"),
        F.when(F.count(_f()) > 0, consistency(F.stddev_pop(_f()))).alias("consistency_score"),
        F.avg(_g()).alias("avg_quali_position"),
        F.min(_g()).alias("best_quali"),
    )
    return stats.filter(F.col("appearances") >= min_appearances)


def overtaking(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Places gained by winners, comebacks from outside the top five, front-row share."""
    won = F.count(F.lit(1))
    return winners(results).groupBy(*keys).agg(
        F.coalesce(F.avg(_g() - _f()), F.lit(0.0)).alias("average_position_changes"),
        count_where(_g() > 5).alias("comeback_victories"),
        ratio(count_where(_g() <= 2), won).alias("front_runner_dominance"),
    )


def overtaking_stats(results: DataFrame, dim: DataFrame) -> DataFrame:
    """As `overtaking`, with the circuit's difficulty word and rating."""
    stats = winners(results).groupBy("circuit_name").agg(
        F.coalesce(F.avg(_g() - 1), F.lit(0.0)).alias("average_position_changes"),
        ratio(count_where(_g() <= 2), F.count(F.lit(1))).alias("front_runner_advantage"),
    )
    return with_circuit(stats, dim).select(
        "circuit_name", "average_position_changes", "front_runner_advantage",
        F.col("overtaking_difficulty").alias("comeback_difficulty"),
        difficulty(F.col("overtaking_difficulty")).alias("drs_zones_effectiveness"),
    )


def reliability(results: DataFrame, keys: Sequence[str] = ("circuit_name", "driver_code")) -> DataFrame:
    """Retirement rates per driver, per circuit and overall (NULL keys are totals)."""
    out = (F.col("status") != "Finished") & _f().isNull()
    n = F.count(F.lit(1))
    return results.rollup(*keys).agg(
        n.alias("total_races"),
        count_where(out).alias("dnfs"),
        (count_where(out) / n).alias("dnf_rate"),
    )


def driver_statistics(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Full record of each driver; drivers without a value get the worst-case default."""
    gain = _g() - _f()
    zero, twenty = F.lit(0.0), F.lit(20.0)
    return results.groupBy(*keys, "driver_code").agg(
        F.count(F.lit(1)).alias("races"),
        count_where(_f() == 1).alias("wins"),
        count_where(_f() <= 3).alias("podiums"),
        count_where(_f() <= 10).alias("points_finishes"),
        count_where(_f().isNull()).alias("dnfs"),
        F.coalesce(F.avg(_f()), twenty).alias("avg_position"),
        F.when(F.count(_f()) > 0, consistency(F.stddev_pop(_f()))).otherwise(0.0).alias("consistency"),
        F.coalesce(F.avg(_g()), twenty).alias("avg_quali_position"),
        F.coalesce(F.min(_g()), F.lit(20)).alias("best_quali"),
        F.when(F.count(_g()) > 0, consistency(F.stddev_pop(_g()))).otherwise(0.0).alias("quali_consistency"),
        F.coalesce(F.avg(gain), zero).alias("avg_position_gain"),
        F.coalesce(F.max(gain), F.lit(0)).alias("best_comeback"),
        F.coalesce(ratio(count_where(gain > 0), F.count(gain)), zero).alias("comeback_frequency"),
    )


def team_statistics(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Record of each team and the number of seasons it was there."""
    return results.groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("races"),
        count_where(_f() == 1).alias("wins"),
        count_where(_f() <= 3).alias("podiums"),
        count_where(_f() <= 10).alias("points_finishes"),
        F.coalesce(F.avg(_f()), F.lit(15.0)).alias("avg_position"),
        F.when(F.count(_f()) > 0, consistency(F.stddev_pop(_f()))).otherwise(0.0).alias("consistency"),
        F.count_distinct("season_year").alias("years_active"),
    )


def classify_specialists(stats: DataFrame, min_races: int = 3, keys: Sequence[str] = BY) -> DataFrame:
    """One row per driver and class earned, from `driver_statistics`."""
    win, podium = F.col("wins") / F.col("races"), F.col("podiums") / F.col("races")
    points = F.col("points_finishes") / F.col("races")

    def label(condition: Column, name: str, score: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("class"), score.cast("double").alias("score")))

    classes = F.array(
        label(win >= 0.3, "race_winner", win * 0.6 + podium * 0.4),
        label(points >= 0.7, "consistent_performer", 1.0 - F.col("dnfs") / F.col("races")),
        label(F.col("avg_quali_position") <= 5, "qualifying_master", F.col("avg_quali_position")),
        label(F.col("avg_position_gain") > 2, "comeback_specialist", F.col("avg_position_gain")),
    )
    earned = F.filter(classes, lambda c: c.isNotNull())
    return (
        stats.filter(F.col("races") >= min_races)
        .withColumn("__c", F.explode(earned))
        .select(*keys, "driver_code", F.col("__c.class").alias("class"), F.col("__c.score").alias("score"))
    )


def dominant_teams(stats: DataFrame, min_entries: int = 3) -> DataFrame:
    """Teams with a high win or podium rate, from `team_statistics`."""
    win, podium = F.col("wins") / F.col("races"), F.col("podiums") / F.col("races")
    return (
        stats.withColumns({"win_rate": win, "podium_rate": podium})
        .filter((F.col("races") >= min_entries) & ((win > 0.2) | (podium > 0.4)))
        .drop("wins", "podiums", "points_finishes", "consistency", "years_active", "races")
    )


def history_overview(results: DataFrame) -> DataFrame:
    """Races, seasons covered and winner diversity per circuit."""
    return races(results).groupBy("circuit_name").agg(
        F.count(F.lit(1)).alias("total_races"),
        F.sort_array(F.collect_set("season_year")).alias("years_covered"),
        F.coalesce(ratio(F.count_distinct("winner"), F.count("winner")), F.lit(0.0)).alias("winner_diversity"),
    )


def success_patterns(results: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Where winners start, in percent, and upsets from outside the top three."""
    known = F.count(_g())
    return winners(results).groupBy(*keys).agg(
        F.avg(_g()).alias("avg_starting_position"),
        count_where(_g() > 3).alias("upset_victories"),
        (ratio(count_where(_g() == 1), known) * 100).alias("pole_win_percentage"),
        (ratio(count_where(_g() <= 2), known) * 100).alias("front_row_win_percentage"),
        (ratio(count_where(_g() <= 5), known) * 100).alias("top_5_win_percentage"),
    )


def weather_patterns(results: DataFrame, weather: DataFrame) -> DataFrame:
    """Rain frequency over all races, temperature spread over those with weather."""
    temp = F.col("air_temp_avg")
    return _weathered(results, weather).groupBy("circuit_name").agg(
        (count_where(F.coalesce(F.col("rainfall"), F.lit(False))) / F.count(F.lit(1))).alias("rain_frequency"),
        F.avg(temp).alias("avg_temperature"),
        F.min(temp).alias("min_temperature"),
        F.max(temp).alias("max_temperature"),
        F.var_pop(temp).alias("temperature_variance"),
    )


def circuit_difficulty(results: DataFrame, dim: DataFrame) -> DataFrame:
    """Overall rating from overtaking, qualifying, weather and unpredictability.

    Unpredictability is the mean of winner diversity and the rate of wins from outside
    the first three grid slots.
    """
    upsets = winners(results).groupBy("circuit_name").agg(
        F.count_distinct("driver_code").alias("__distinct"), count_where(_g() > 3).alias("__upsets")
    )
    held = races(results).groupBy("circuit_name").agg(F.count(F.lit(1)).alias("__races"))
    joined = with_circuit(held.join(upsets, "circuit_name", "left"), dim)
    n = F.col("__races")
    diversity = F.coalesce(F.col("__distinct"), F.lit(0)) / n
    upset_rate = F.coalesce(F.col("__upsets"), F.lit(0)) / n
    rating = (
        difficulty(F.col("overtaking_difficulty")) * 0.3
        + F.col("qualifying_importance") * 0.25
        + F.col("weather_sensitivity") * 0.2
        + F.col("unpredictability_factor") * 0.25
    )
    return (
        joined.withColumn("unpredictability_factor", (diversity + upset_rate) / 2)
        .withColumn("overall_rating", rating)
        .select("circuit_name", "unpredictability_factor", "overall_rating")
    )


def quality_tier(df: DataFrame, col: str = "total_races") -> DataFrame:
    """Add `data_quality` from the number of races analysed."""
    n = F.col(col)
    tier = F.when(n >= 7, "excellent").when(n >= 5, "good").when(n >= 3, "fair").otherwise("limited")
    return df.withColumn("data_quality", tier)


def historical_features(results: DataFrame, keys: Sequence[str] = ("driver_code",)) -> DataFrame:
    """Past record of each driver as model input; rates are over finished races."""
    n, done = F.count(F.lit(1)), F.count(_f())

    def rate(condition: Column, default: float) -> Column:
        return F.coalesce(ratio(count_where(condition), done), F.lit(default))

    return results.groupBy(*keys).agg(
        F.coalesce(F.avg(_f()), F.lit(12.0)).alias("historical_avg_position"),
        F.coalesce(F.min(_f()).cast("double"), F.lit(15.0)).alias("historical_best_position"),
        F.when(done > 0, consistency(F.stddev_pop(_f()))).otherwise(0.5).alias("historical_consistency"),
        rate(_f() == 1, 0.0).alias("historical_win_rate"),
        rate(_f() <= 3, 0.0).alias("historical_podium_rate"),
        rate(_f() <= 10, 0.3).alias("historical_points_rate"),
        F.coalesce(F.avg(_g()), F.lit(12.0)).alias("historical_quali_avg"),
        F.coalesce(F.min(_g()).cast("double"), F.lit(15.0)).alias("historical_quali_best"),
        n.alias("circuit_race_count"),
        F.least(n / 5.0, F.lit(1.0)).alias("circuit_experience"),
        (count_where(_f().isNull()) / n).alias("circuit_dnf_rate"),
        F.sum("points").alias("historical_total_points"),
    )


def features_before(
    asked: DataFrame,
    results: DataFrame,
    keys: Sequence[str] = ("driver_code",),
    by: Sequence[str] = (),
    wins: bool = False,
) -> DataFrame:
    """`historical_features` per (keys, season) of `asked`, from the results of earlier seasons only.

    All seasons in one pass over the results; no row where there is no earlier result. The
    deviation comes from sums of whole numbers, so it is exact up to the last root. `by` as in
    `before`; with `wins`, the count of wins is added.
    """
    f, g = _f().cast("long"), _g().cast("long")

    def hits(condition: Column) -> tuple[str, Column]:
        return "sum", condition.cast("long")

    states = {
        "n": ("sum", F.lit(1).cast("long")), "gone": hits(f.isNull()), "points": ("sum", F.col("points")),
        "done": hits(f.isNotNull()), "f": ("sum", f), "ff": ("sum", f * f), "f_min": ("min", f),
        "first": hits(f == 1), "third": hits(f <= 3), "tenth": hits(f <= 10),
        "seen": hits(g.isNotNull()), "g": ("sum", g), "g_min": ("min", g),
    }
    states = {f"__{name}": state for name, state in states.items()}
    n, done, total = F.col("__n"), F.col("__done"), F.col("__f")

    def rate(name: str, default: float) -> Column:
        return F.coalesce(ratio(F.coalesce(name, F.lit(0)), done), F.lit(default))

    spread = F.sqrt(F.greatest(done * F.col("__ff") - total * total, F.lit(0))) / done
    return (
        before(asked, results, keys, states, by=by)
        .filter(n > 0)
        .select(
            *keys,
            "season_year",
            F.coalesce(ratio(total, done), F.lit(12.0)).alias("historical_avg_position"),
            F.coalesce(F.col("__f_min").cast("double"), F.lit(15.0)).alias("historical_best_position"),
            F.when(done > 0, consistency(spread)).otherwise(0.5).alias("historical_consistency"),
            rate("__first", 0.0).alias("historical_win_rate"),
            rate("__third", 0.0).alias("historical_podium_rate"),
            rate("__tenth", 0.3).alias("historical_points_rate"),
            F.coalesce(ratio(F.col("__g"), F.col("__seen")), F.lit(12.0)).alias("historical_quali_avg"),
            F.coalesce(F.col("__g_min").cast("double"), F.lit(15.0)).alias("historical_quali_best"),
            n.alias("circuit_race_count"),
            F.least(n / 5.0, F.lit(1.0)).alias("circuit_experience"),
            (F.col("__gone") / n).alias("circuit_dnf_rate"),
            F.col("__points").alias("historical_total_points"),
            *([F.col("__first").alias("wins")] if wins else []),
        )
    )


def win_counts(results: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Wins per driver, on the roster if one is given."""
    won = winners(results)
    if roster is not None:
        won = won.join(roster.select("driver_code"), "driver_code", "left_semi")
    return won.groupBy("driver_code").agg(F.count(F.lit(1)).alias("wins"))


def data_confidence(results: DataFrame, circuit: str) -> DataFrame:
    """Confidence in a driver's record from races at the circuit and in the whole career."""
    here = count_where(F.contains(F.lower("circuit_name"), F.lit(circuit.lower())))
    score = 0.7 * F.least(F.lit(1.0), here / 3.0) + 0.3 * F.least(F.lit(1.0), F.count(F.lit(1)) / 20.0)
    return results.groupBy("driver_code").agg(F.round(score, 2).alias("data_confidence"))


def substitute_winner(results: DataFrame, roster: DataFrame) -> DataFrame:
    """Race winners among active drivers: an inactive winner gives way to the best active finisher."""
    on = results.join(roster.select("driver_code"), "driver_code", "left_semi")
    best = top_n(
        on.filter(_f().isNotNull()), RACE, [_f(), F.col("driver_code")], 1
    ).select(*RACE, F.col("driver_code").alias("__best"))
    out = races(results).join(best, RACE, "left")
    # An active winner is also the best active finisher; a race without winner keeps none.
    return out.withColumn("active_winner", F.when(F.col("winner").isNotNull(), F.col("__best"))).drop("__best")


def constructor_standings(standings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points per team, best first."""
    summed = standings.groupBy(*keys, "team").agg(F.sum("points").alias("points"))
    return summed.orderBy(*keys, F.col("points").desc(), "team")


def session_weather(samples: DataFrame, keys: Sequence[str] = (*RACE, "circuit_name", "session_type")) -> DataFrame:
    """Mean conditions of a session, whether it rained at all, and the record count."""
    return samples.groupBy(*keys).agg(
        F.avg("air_temp").alias("air_temp_avg"),
        F.avg("track_temp").alias("track_temp_avg"),
        F.avg("humidity").alias("humidity_avg"),
        F.avg("pressure").alias("pressure_avg"),
        F.avg("wind_speed").alias("wind_speed_avg"),
        F.bool_or("rainfall").alias("rainfall"),
        F.count(F.lit(1)).alias("weather_records"),
    )


def roster_breakdown(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Experienced, rookie and total drivers."""
    return features.groupBy(*keys).agg(
        count_where(~F.col("is_rookie")).alias("experienced_drivers"),
        count_where(F.col("is_rookie")).alias("rookie_drivers"),
        F.count(F.lit(1)).alias("total_active_drivers"),
    )
