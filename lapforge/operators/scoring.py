"""Rule-based scoring: one row per driver and race, features to win probabilities.

Steps take and return the same rows with more columns. Driver groups are given as
conditions, by default the fixed lists of driver codes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import constants as k
from lapforge.operators.asof import State, before
from lapforge.operators.groups import attach, top_n, with_rank
from lapforge.operators.history import features_before
from lapforge.operators.marts import consistency, count_where, normalize, ratio

RACE = ["season_year", "round_number"]
HISTORY_DEFAULTS = {
    "historical_avg_position": 12.0,
    "historical_best_position": 15.0,
    "historical_consistency": 0.5,
    "historical_win_rate": 0.0,
    "historical_podium_rate": 0.0,
    "historical_points_rate": 0.3,
    "historical_quali_avg": 12.0,
    "historical_quali_best": 15.0,
    "circuit_race_count": 0,
    "circuit_experience": 0.0,
    "circuit_dnf_rate": 0.0,
    "historical_total_points": 0.0,
}


def _in(codes: Sequence[str]) -> Column:
    return F.col("driver_code").isin(list(codes))


def _by_type(table: Mapping[str, Sequence[str]]) -> Column:
    """Whether the driver is in the list of the row's circuit type."""
    hits = [(F.col("circuit_type") == t) & _in(codes) for t, codes in table.items()]
    return reduce(lambda a, b: a | b, hits)


def simple_form(position: Column) -> Column:
    return F.greatest(F.lit(0.1), (21 - position) / 20.0)


def form_score(df: DataFrame) -> DataFrame:
    """Add `current_form_score` from the championship position; rookies score in bands."""
    p = F.col("championship_position")
    rookie = (
        F.when(p <= 8, 0.7 + 0.2 * (9 - p) / 8)
        .when(p <= 15, 0.4 + 0.3 * (16 - p) / 7)
        .otherwise(0.2 + 0.2 * (21 - p) / 5)
    )
    return df.withColumn("current_form_score", F.when(F.col("is_rookie"), rookie).otherwise(simple_form(p)))


def team_momentum(df: DataFrame) -> DataFrame:
    """Add `current_team_performance` from the team rank and `recent_momentum` from points."""
    points = F.col("championship_points")
    return df.withColumns(
        {
            "current_team_performance": F.greatest(F.lit(0.1), (11 - F.col("team_rank")) / 10.0),
            "recent_momentum": F.when(points > 50, 0.8).when(points > 20, 0.6).otherwise(0.4),
        }
    )


def qualifying_features(df: DataFrame) -> DataFrame:
    """Add the qualifying advantage and bonuses; a driver without a grid slot starts 20th without any.

    Reads `grid_position`, `configured_importance` and `avg_quali_position`.
    """
    g = F.col("grid_position")
    advantage = F.greatest(F.lit(0.05), (21 - g) / 20.0) * F.coalesce("configured_importance", F.lit(0.85))
    known = g.isNotNull()
    return df.withColumns(
        {
            "qualifying_advantage": F.when(known, advantage).otherwise(0.0),
            "pole_position_bonus": F.when(g == 1, 0.25).otherwise(0.0),
            "front_row_bonus": F.when(g == 2, 0.15).otherwise(0.0),
            "top_5_bonus": F.when(g.between(3, 5), 0.10).otherwise(0.0),
            "avg_quali_position": F.coalesce("avg_quali_position", F.lit(15.0)),
        }
    ).withColumn("grid_position", F.coalesce(g, F.lit(20)))


def weather_features(df: DataFrame, rain: Column | None = None, heat: Column | None = None) -> DataFrame:
    """Add rain, heat and risk features from race-day `temperature` and `rain_probability` (0..100).

    Without race-day conditions everything stays neutral.
    """
    rain = _in(k.RAIN_SPECIALISTS) if rain is None else rain
    heat = _in(k.HEAT_TOLERANT) if heat is None else heat
    known = F.col("temperature").isNotNull() | F.col("rain_probability").isNotNull()
    chance = F.coalesce(F.col("rain_probability"), F.lit(0.0))
    hot = known & (F.coalesce(F.col("temperature"), F.lit(25.0)) > 30)
    specialist = F.when(known & rain & (chance > 30), F.least(chance / 100.0, F.lit(0.3))).otherwise(0.0)
    return df.withColumns(
        {
            "rain_specialist": specialist,
            "heat_tolerance": F.when(hot & heat, 0.8).when(hot, 0.3).otherwise(0.5),
            "weather_advantage": 0.5 + specialist + F.when(hot & heat, 0.1).otherwise(0.0),
            "weather_risk_factor": F.when(hot & ~heat, 0.1).otherwise(0.0)
            + F.when(known & F.col("is_rookie"), 0.1).otherwise(0.0),
        }
    )


def circuit_features(df: DataFrame, specialist: Column | None = None, overtaker: Column | None = None) -> DataFrame:
    """Add circuit-type, overtaking and past-winner features; reads `wins`."""
    specialist = _by_type(k.TYPE_SPECIALISTS) if specialist is None else specialist
    overtaker = _in(k.OVERTAKERS) if overtaker is None else overtaker
    rookie = F.col("is_rookie")
    base = F.when(specialist, 0.2).otherwise(0.0)
    hard = F.col("overtaking_difficulty").isin("high", "very_high")
    bonus = F.least(F.coalesce(F.col("wins"), F.lit(0)) * 0.1, F.lit(0.3))
    return df.withColumns(
        {
            "circuit_type_advantage": F.when(rookie, base * 0.5).otherwise(base),
            "overtaking_advantage": F.when(hard & overtaker, F.when(rookie, 0.05).otherwise(0.15)).otherwise(0.0),
            "historical_winner_bonus": F.when(rookie, 0.0).otherwise(bonus),
        }
    )


def expected_performance(df: DataFrame) -> DataFrame:
    """Add expected qualifying and race position and the competitiveness score."""
    importance, advantage = F.col("qualifying_importance"), F.col("qualifying_advantage")
    past, rookie = F.col("historical_avg_position"), F.col("is_rookie")
    start = F.when(F.col("grid_position") < 20, F.col("grid_position").cast("double"))
    start = start.otherwise(F.col("avg_quali_position"))
    race = start * importance + past * (1 - importance) - advantage * 10
    race = race + F.when(rookie, F.col("rookie_penalty") * 3).otherwise(0.0)
    score = (
        F.col("current_form_score") * 0.4
        + (21 - past) / 20 * 0.2
        + F.col("weather_advantage") * 0.1
        + F.col("circuit_experience") * 0.05
        + advantage * 0.25
    )
    score = F.when(rookie, score * 0.9).otherwise(score)
    return df.withColumns(
        {
            "expected_quali_position": start,
            "expected_race_position": F.least(F.lit(20.0), F.greatest(F.lit(1.0), race)),
            "competitiveness_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)),
        }
    )


def rookie_features(season: DataFrame, standings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Current-season record of each driver in the standings, as a stand-in for history.

    With `by`, of every season: the standings carry the season that they apply to.
    """
    f, key = F.col("finish_position"), [*by, "driver_code"]
    done = F.count(f)
    record = season.groupBy(*key).agg(
        F.avg(f).alias("__avg"),
        F.min(f).alias("__best"),
        F.when(done > 0, consistency(F.stddev_pop(f))).alias("__cons"),
        ratio(count_where(f <= 10), done).alias("__points"),
        ratio(count_where(f <= 3), done).alias("__podium"),
        done.alias("__n"),
    )
    p, points = F.col("position"), F.col("points")
    table = standings.select(*key, "position", "points")
    avg = F.coalesce("__avg", F.least(p + 2, F.lit(20)).cast("double"))
    best = F.coalesce(F.col("__best"), F.greatest(F.lit(1), p - 5)).cast("double")
    return table.join(record, key, "left").select(
        *key,
        avg.alias("historical_avg_position"),
        best.alias("historical_best_position"),
        F.coalesce("__cons", F.lit(0.5)).alias("historical_consistency"),
        F.lit(0.0).alias("historical_win_rate"),
        F.coalesce("__podium", F.when(p <= 10, 0.1).otherwise(0.0)).alias("historical_podium_rate"),
        F.coalesce("__points", F.when(points > 0, 0.3).otherwise(0.0)).alias("historical_points_rate"),
        F.least(avg + 1, F.lit(20.0)).alias("historical_quali_avg"),
        F.greatest(F.lit(1.0), best).alias("historical_quali_best"),
        F.lit(0).cast("long").alias("circuit_race_count"),
        F.lit(0.0).alias("circuit_experience"),
        F.lit(0.05).alias("circuit_dnf_rate"),
        points.alias("historical_total_points"),
        F.coalesce("__n", F.lit(0)).alias("season_races"),
    )


def proxy_history(
    entries: DataFrame,
    history: DataFrame,
    rookies: DataFrame,
    keys: Sequence[str] = ("circuit_name",),
    by: Sequence[str] = (),
) -> DataFrame:
    """Add past-record features; inexperienced drivers take their teammate's, slightly worse.

    `entries` has `is_rookie`, `data_confidence` and `teammate`; `history` is keyed by `by`,
    `keys` and driver, `rookies` by `by` and driver. Without a teammate the current season stands in.
    """
    keys = [*by, *keys]
    own = _record(history, "__own_", [*keys, "driver_code"])
    mate = _record(history, "__mate_", [*keys, "driver_code"]).withColumnRenamed("driver_code", "teammate")
    fresh = _record(rookies, "__new_", [*by, "driver_code"])
    joined = (
        entries.join(own, [*keys, "driver_code"], "left")
        .join(mate, [*keys, "teammate"], "left")
        .join(fresh, [*by, "driver_code"], "left")
    )
    return _chosen_history(joined)


def _record(df: DataFrame, prefix: str, on: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    return df.select(*on, *more, *[F.col(c).alias(prefix + c) for c in HISTORY_DEFAULTS])


def _chosen_history(joined: DataFrame) -> DataFrame:
    """The past-record features out of the own, the teammate's and the season's record."""
    proxy = F.col("is_rookie") | (F.col("data_confidence") < 0.4)
    has_mate = F.col("teammate").isNotNull()
    taxed = {
        "historical_avg_position": lambda c: F.least(F.lit(20.0), c + 2),
        "historical_consistency": lambda c: F.greatest(F.lit(0.1), c * 0.8),
    }
    out = {}
    for c, default in HISTORY_DEFAULTS.items():
        from_mate = F.coalesce(F.col(f"__mate_{c}"), F.lit(default))
        if c in taxed:
            from_mate = taxed[c](from_mate)
        from_self = F.coalesce(F.col(f"__own_{c}"), F.lit(default))
        from_season = F.coalesce(F.col(f"__new_{c}"), F.lit(default))
        out[c] = F.when(~proxy, from_self).when(has_mate, from_mate).otherwise(from_season)
    out["rookie_penalty"] = F.when(proxy & ~has_mate, 0.15).otherwise(0.0)
    helpers = [f"__{p}_{c}" for p in ("own", "mate", "new") for c in HISTORY_DEFAULTS]
    return joined.withColumns(out).drop(*helpers)


def _race_count(name: str) -> Mapping[str, State]:
    return {name: ("sum", F.lit(1).cast("long"))}


def confidence_before(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Add `data_confidence` from earlier seasons' races at the entry's circuit and in the whole career."""
    here = before(entries, history, ["circuit_name", "driver_code"], _race_count("__here"))
    career = before(entries, history, ["driver_code"], _race_count("__career"))
    return _confidence(
        entries.join(here, ["season_year", "circuit_name", "driver_code"], "left")
        .join(career, ["season_year", "driver_code"], "left")
    )


def _confidence(counted: DataFrame) -> DataFrame:
    at, all_ = F.coalesce("__here", F.lit(0)), F.coalesce("__career", F.lit(0))
    score = 0.7 * F.least(F.lit(1.0), at / 3.0) + 0.3 * F.least(F.lit(1.0), all_ / 20.0)
    return counted.withColumn("data_confidence", F.round(score, 2)).drop("__here", "__career")


def prediction_features(
    entries: DataFrame,
    results: DataFrame,
    rookies: DataFrame,
    rain: Column | None = None,
    heat: Column | None = None,
    specialist: Column | None = None,
    overtaker: Column | None = None,
) -> DataFrame:
    """All model features for every entry, of any number of seasons.

    `entries`: one row per race and active driver with circuit attributes, standings,
    teammate, grid slot and race-day weather already joined; `results`: the results of all
    seasons, of which each entry sees those before its own; `rookies` by season and driver.

    This is `confidence_before` and `proxy_history` over one record per driver, season and circuit.
    Everything is dealt by driver, whose entries and results are those of one career; a teammate's
    record is brought to the driver, so the wide entries move once. Under `joins_by_some_keys` the
    joins leave them there, and the order of the first serves them all; otherwise they are right
    too, but shuffle more.
    """
    places, by, season = ["season_year", "circuit_name"], ["driver_code"], ["driver_code", "season_year"]
    key = [*season, "circuit_name"]
    # A driver's record is also asked for as a teammate's.
    pairs = entries.filter("teammate IS NOT NULL").select(*key, "teammate").distinct()
    asked = entries.select(*key).unionByName(pairs.select(*places, F.col("teammate").alias("driver_code")))
    past = features_before(asked, results, ("driver_code", "circuit_name"), by, wins=True)
    career = before(entries, results, by, _race_count("__career"), by=by)
    own = _record(past, "__own_", key, ["wins", F.col("circuit_race_count").alias("__here")])
    mate = _record(past, "__mate_", key).withColumnRenamed("driver_code", "teammate")
    mate = pairs.repartition("teammate").join(mate, [*places, "teammate"]).repartition(*by)
    fresh = _record(rookies, "__new_", season).repartition(*by)
    df = (
        entries.repartition(*by)
        .join(mate, [*key, "teammate"], "left")
        .join(own, key, "left")
        .join(career, season, "left")
        .join(fresh, season, "left")
    )
    df = team_momentum(form_score(_chosen_history(_confidence(df))))
    df = weather_features(qualifying_features(df), rain, heat)
    return expected_performance(circuit_features(df, specialist, overtaker))


def grid_boost(df: DataFrame) -> DataFrame:
    """Add `grid_boost`, which rewards the front of the grid without deciding the race."""
    g, w = F.col("grid_position"), F.col("qualifying_importance")
    boost = (
        F.when(g == 1, w * 0.4)
        .when(g == 2, w * 0.25)
        .when(g == 3, w * 0.15)
        .when(g <= 5, w * 0.10)
        .when(g <= 10, w * 0.05)
        .otherwise(0.0)
    )
    return df.withColumn("grid_boost", boost)


def team_advantage(
    df: DataFrame, col: str = "current_team", table: Mapping[str, float] = k.TEAM_STRENGTH
) -> DataFrame:
    """Add `team_advantage` by team name, tried again without the word Racing."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    name = F.coalesce(F.col(col), F.lit("Unknown"))
    short = F.trim(F.replace(name, F.lit("Racing"), F.lit("")))
    found = F.coalesce(F.try_element_at(pairs, name), F.try_element_at(pairs, short))
    return df.withColumn("team_advantage", F.coalesce(found, F.lit(k.TEAM_STRENGTH_DEFAULT)))


def _with_main(df: DataFrame) -> DataFrame:
    df = team_advantage(grid_boost(df))
    score = (
        (21 - F.col("championship_position")) / 20.0 * 0.4
        + (21 - F.col("historical_avg_position")) / 20.0 * 0.2
        + F.col("grid_boost") * 0.25
        + F.col("circuit_type_advantage") * 0.1
        + F.col("team_advantage") * 0.05
    )
    score = F.when(F.col("is_rookie"), score * 0.85).otherwise(score)
    return df.withColumn("main_score", F.greatest(F.lit(0.01), F.least(F.lit(0.95), score)))


def _with_pattern(df: DataFrame, results: DataFrame) -> DataFrame:
    races = results.select("circuit_name", *RACE).distinct()
    held = before(df, races, ["circuit_name"], _race_count("__races"))
    base = 0.5 + F.coalesce(F.col("wins"), F.lit(0)) / F.col("__races") * 0.3
    score = F.greatest(F.lit(0.01), F.least(F.lit(0.99), base * (0.5 + F.col("current_form_score"))))
    scored = df.join(held, ["season_year", "circuit_name"], "left")
    return scored.withColumn("pattern_score", F.when(F.col("__races") >= 3, score)).drop("__races")


def main_score(df: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Add `main_score`, summing to 1 per race."""
    return normalize(_with_main(df), keys, "main_score")


def pattern_score(df: DataFrame, results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Pattern scores from wins at the circuit in earlier seasons; no rows where it had under three races."""
    scored = _with_pattern(df, results).filter(F.col("pattern_score").isNotNull())
    return normalize(scored.select(*keys, "driver_code", "pattern_score"), keys, "pattern_score")


def win_probabilities(features: DataFrame, results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Add `win_probability` in percent: 0.7 of the main and 0.3 of the pattern score.

    Both scores are made in one pass over the features and scaled by one aggregate per race.
    """
    scored = _with_pattern(_with_main(features), results)
    sums = {"__main": F.sum("main_score"), "__pattern": F.sum("pattern_score")}
    main = F.col("main_score") / F.col("__main")
    pattern = F.coalesce(F.col("pattern_score") / F.col("__pattern"), F.lit(0.0))
    return attach(scored, keys, sums).withColumn("win_probability", (main * 0.7 + pattern * 0.3) * 100).drop(*sums)


def predict(features: DataFrame, results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Win probability in percent and rank for every driver and race; ties go by driver code."""
    scored = win_probabilities(features, results, keys)
    return with_rank(scored, keys, "win_probability", "rank", descending=True, tiebreak="driver_code")


def top_predictions(scores: DataFrame, n: int = 10, keys: Sequence[str] = RACE, col: str = "win_probability") -> DataFrame:
    """The `n` most likely winners of each race, ranked."""
    return top_n(scores.drop("rank"), keys, [F.col(col).desc(), F.col("driver_code")], n, "rank")


def circuit_advantage(df: DataFrame, specialist: Column | None = None, home: Column | None = None) -> DataFrame:
    """Add `circuit_advantage`: specialist, home race and past wins, at most 0.4."""
    if specialist is None:
        specialist = _by_type({**k.TYPE_SPECIALISTS, "mixed": k.MIXED_SPECIALISTS})
    if home is None:
        places = [(F.col("circuit_key") == c) & _in(codes) for c, codes in k.HOME_DRIVERS.items()]
        home = reduce(lambda a, b: a | b, places)
    total = (
        F.when(specialist, 0.15).otherwise(0.0)
        + F.when(home, 0.2).otherwise(0.0)
        + F.coalesce(F.col("historical_winner_bonus"), F.lit(0.0))
    )
    return df.withColumn("circuit_advantage", F.least(total, F.lit(0.4)))
