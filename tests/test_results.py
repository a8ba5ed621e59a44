import math

import pytest
from pyspark.sql import functions as F

from lapforge.operators import history as h
from lapforge.operators import joins as j
from lapforge.operators import marts as m
from lapforge.operators import scoring as sc


def one(df, **where):
    for c, v in where.items():
        df = df.filter(F.col(c) == v)
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_historical_features(history):
    out = h.historical_features(history)
    ver = one(out, driver_code="VER")
    assert math.isclose(ver.historical_avg_position, 7 / 3)
    assert math.isclose(ver.historical_win_rate, 2 / 3)
    assert ver.historical_best_position == 1 and ver.circuit_experience == 0.6
    assert math.isclose(one(out, driver_code="NOR").historical_podium_rate, 2 / 3)
    lec = one(out, driver_code="LEC")
    assert (lec.historical_avg_position, lec.historical_win_rate, lec.circuit_dnf_rate) == (12.0, 0.0, 1.0)


def test_scaffold_fills_drivers_without_history(spark, history):
    roster = spark.createDataFrame([("VER",), ("SAI",)], "driver_code string")
    facts = h.historical_features(history).select("driver_code", "historical_avg_position", "circuit_race_count")
    sai = one(j.scaffold(roster, facts, {"historical_avg_position": 12.0, "circuit_race_count": 0}), driver_code="SAI")
    assert (sai.historical_avg_position, sai.circuit_race_count) == (12.0, 0)


def test_mart_and_reliability(history):
    ver = one(m.driver_circuit_performance(history), driver_code="VER")
    assert (ver.races_at_circuit, ver.wins, ver.podiums, ver.total_points) == (3, 2, 2, 60.0)
    assert math.isclose(ver.avg_positions_gained, (9 + 1 - 2) / 3)
    total = h.reliability(history).filter("circuit_name IS NULL AND driver_code IS NULL").collect()[0]
    assert (total.total_races, total.dnfs) == (10, 1)


def test_weighted_mean_decays_by_half_life(spark, history):
    seed = spark.createDataFrame([("Hungarian Grand Prix", 0.5)], "circuit_name string, regulation_similarity_weight double")
    ver = one(m.driver_circuit_performance(history, seed, 1.0), driver_code="VER")
    assert math.isclose(ver.weighted_avg_finish, (1 * 0.25 + 1 * 0.5 + 5 * 1) / 1.75)


def test_rates_lie_between_zero_and_one(history):
    stats = h.driver_statistics(history).collect()
    assert all(0 <= r.consistency <= 1 and 0 <= r.comeback_frequency <= 1 for r in stats)
    share = m.normalize(history, h.RACE, "points", "share").groupBy(*h.RACE).agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in share)


def test_winner_substitution(spark, history, rows):
    roster = spark.createDataFrame([("NOR",), ("HAM",)], "driver_code string")
    out = h.substitute_winner(history, roster)
    assert rows(out, "season_year", "winner", "active_winner") == [(2022, "VER", "HAM"), (2023, "VER", "NOR"), (2024, "PIA", "NOR")]
    nobody = spark.createDataFrame([("SAI",)], "driver_code string")
    assert {r.active_winner for r in h.substitute_winner(history, nobody).collect()} == {None}


def test_qualifying_impact_defaults(spark, history):
    dim = spark.createDataFrame([], "circuit_name string, qualifying_importance double, overtaking_difficulty string, circuit_type string, weather_sensitivity double")
    out = h.qualifying_impact(history, dim).collect()[0]
    assert out.pole_to_win_rate == 0.0 and math.isclose(out.front_row_advantage, 2 / 3)
    assert math.isclose(out.qualifying_importance_score, (0.7 + 1 / 3) / 2)


def test_teammate_order_of_sources(spark, history):
    drivers = spark.createDataFrame([(d,) for d in ["PIA", "NOR", "HAM", "ANT", "ALO"]], "driver_code string")
    table = spark.createDataFrame([("HAM", "Ferrari"), ("LEC", "Ferrari")], "driver_code string, team string")
    roster = spark.createDataFrame([("ANT", "Mercedes"), ("RUS", "Mercedes"), ("ALO", "Aston Martin")], "driver_code string, team string")
    got = {r.driver_code: (r.teammate, r.teammate_source) for r in j.teammate(drivers, table, history, roster).collect()}
    assert got == {
        "PIA": ("NOR", "results"), "NOR": ("PIA", "results"), "HAM": ("LEC", "standings"),
        "ANT": ("RUS", "roster"), "ALO": (None, None),
    }


def scored_entries(spark):
    columns = (
        "season_year int, round_number int, circuit_name string, driver_code string, championship_position int, championship_points double, "
        "current_team string, team_rank int, is_rookie boolean, historical_avg_position double, grid_position int, qualifying_importance double, "
        "circuit_type_advantage double, current_form_score double, wins long"
    )
    data = [
        (2025, 14, "Hungarian Grand Prix", "PIA", 1, 284.0, "McLaren", 1, False, 1.0, 2, 0.85, 0.0, 1.0, 1),
        (2025, 14, "Hungarian Grand Prix", "NOR", 2, 275.0, "McLaren", 1, False, 2.7, 3, 0.85, 0.0, 0.95, 0),
        (2025, 14, "Hungarian Grand Prix", "VER", 3, 187.0, "Red Bull Racing", 4, False, 2.3, 8, 0.85, 0.2, 0.9, 2),
        (2025, 14, "Hungarian Grand Prix", "ANT", 7, 64.0, "Mercedes", 3, True, 9.0, 15, 0.85, 0.0, 0.75, 0),
    ]
    return spark.createDataFrame(data, columns)


def test_prediction_is_a_ranked_distribution(spark, history):
    out = sc.predict(scored_entries(spark), history).orderBy("rank").collect()
    assert math.isclose(sum(r.win_probability for r in out), 100.0)
    assert [r.rank for r in out] == [1, 2, 3, 4]
    assert [r.win_probability for r in out] == sorted((r.win_probability for r in out), reverse=True)
    assert out[-1].driver_code == "ANT"


def test_pattern_needs_three_races(spark, history):
    few = history.filter("season_year < 2024")
    assert sc.pattern_score(scored_entries(spark), few).count() == 0
    main = {r.driver_code: r.main_score for r in sc.main_score(scored_entries(spark)).collect()}
    # Without a pattern every score keeps its 0.7 share.
    for r in sc.predict(scored_entries(spark), few).collect():
        assert math.isclose(r.win_probability, 70 * main[r.driver_code])


def test_combine_scores(spark):
    a = spark.createDataFrame([("VER", 0.5), ("NOR", 0.6)], "driver_code string, a double")
    b = spark.createDataFrame([("VER", 1.0)], "driver_code string, b double")
    out = {r.driver_code: r.score for r in j.combine_scores(a, b, ["driver_code"], "a", "b").collect()}
    assert math.isclose(out["VER"], 0.65) and math.isclose(out["NOR"], 0.42)


@pytest.mark.parametrize("points, momentum", [(284.0, 0.8), (20.0, 0.4), (26.0, 0.6), (0.0, 0.4)])
def test_momentum_tiers(spark, points, momentum):
    df = spark.createDataFrame([(points, 3)], "championship_points double, team_rank int")
    assert sc.team_momentum(df).collect()[0].recent_momentum == momentum


def test_team_advantage_by_name(spark):
    df = spark.createDataFrame([("McLaren",), ("Haas Racing",), ("Nobody",), (None,)], "current_team string")
    assert [r.team_advantage for r in sc.team_advantage(df).collect()] == [0.25, 0.05, 0.01, 0.01]


def test_weather_and_circuit_rules(spark):
    df = spark.createDataFrame(
        [("HAM", False, 22.0, 65.0, "technical", "high"), ("STR", False, 34.0, 10.0, "technical", "high"), ("ANT", True, None, None, "mixed", "low")],
        "driver_code string, is_rookie boolean, temperature double, rain_probability double, circuit_type string, overtaking_difficulty string",
    ).withColumn("wins", F.lit(5))
    out = {r.driver_code: r for r in sc.circuit_features(sc.weather_features(df)).collect()}
    assert out["HAM"].rain_specialist == 0.3 and out["HAM"].circuit_type_advantage == 0.2 and out["HAM"].historical_winner_bonus == 0.3
    assert out["STR"].rain_specialist == 0.0 and out["STR"].heat_tolerance == 0.3 and out["STR"].weather_risk_factor == 0.1
    assert out["ANT"].weather_risk_factor == 0.0 and out["ANT"].historical_winner_bonus == 0.0


def test_proxy_history_taxes_the_teammate(spark, history):
    entries = spark.createDataFrame(
        [("Hungarian Grand Prix", "ANT", True, 0.0, "HAM"), ("Hungarian Grand Prix", "VER", False, 0.9, "TSU"), ("Hungarian Grand Prix", "BOR", True, 0.0, None)],
        "circuit_name string, driver_code string, is_rookie boolean, data_confidence double, teammate string",
    )
    standings = spark.createDataFrame([("BOR", 17, 14.0)], "driver_code string, position int, points double")
    past = h.historical_features(history, ("circuit_name", "driver_code"))
    rookies = sc.rookie_features(history.filter("season_year = 2099"), standings)
    out = {r.driver_code: r for r in sc.proxy_history(entries, past, rookies).collect()}
    assert out["ANT"].historical_avg_position == 5.0 and out["ANT"].rookie_penalty == 0.0
    assert math.isclose(out["VER"].historical_avg_position, 7 / 3)
    assert out["BOR"].historical_avg_position == 19.0 and out["BOR"].rookie_penalty == 0.15


def test_evaluation(spark):
    pred = spark.createDataFrame([(2024, 1, "A", 1), (2024, 1, "B", 2), (2024, 2, "A", 1), (2024, 2, "C", 4)], "season_year int, round_number int, driver_code string, rank int")
    actual = spark.createDataFrame([(2024, 1, "A"), (2024, 2, "C")], "season_year int, round_number int, winner string")
    out = j.evaluate(pred, actual).collect()[0]
    assert (out.races, out.winner_accuracy, out.top_3_accuracy, out.top_5_accuracy) == (2, 0.5, 0.5, 1.0)
