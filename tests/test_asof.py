"""Records before a season, and the model over several seasons."""

import math

from pyspark.sql import functions as F

from lapforge.operators import asof
from lapforge.operators import history as h
from lapforge.operators import joins as j
from lapforge.operators import scoring as sc

RESULT = "season_year int, round_number int, circuit_name string, driver_code string, team string, grid_position int, finish_position int, points double"


def results(spark):
    rows = []
    for year in (2020, 2021, 2023):  # no races in 2022
        for rnd in (1, 2, 3):
            order = ["A", "B", "C", "D"] if (year + rnd) % 2 else ["B", "A", "D", "C"]
            for place, driver in enumerate(order, 1):
                finish = None if (driver == "D" and rnd == 3) else place
                rows.append((year, rnd, f"Ring {rnd}", driver, "X" if driver in "AB" else "Y", 5 - place, finish, 10.0 / place))
    rows.append((2023, 1, "Ring 1", "E", "Y", 9, 9, 0.0))
    return spark.createDataFrame(rows, RESULT)


def asked(spark):
    return spark.createDataFrame([(y, d) for y in (2020, 2021, 2022, 2023, 2024) for d in "ABCDEF"], "season_year int, driver_code string")


def test_states_merge_over_strictly_earlier_facts(spark, rows):
    facts = spark.createDataFrame([(None, 1, 5), ("a", 1, 3), ("a", 1, 4), ("a", 4, 10), ("a", None, 99), (None, 3, 7)], "k string, at int, x int")
    probes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 5), ("a", 5), ("b", 9), (None, 4)], "k string, at int")
    states = {"total": ("sum", F.col("x")), "least": ("min", F.col("x")), "most": ("max", F.col("x"))}
    got = rows(asof.before(probes, facts, ["k"], states, at="at"), "k", "at", "total", "least", "most")
    assert sorted(got, key=str) == sorted(
        [("a", 1, None, None, None), ("a", 2, 7, 3, 4), ("a", 4, 7, 3, 4), ("a", 5, 17, 3, 10), ("b", 9, None, None, None), (None, 4, 12, 5, 7)], key=str
    )
    assert asof.before(probes.limit(0), facts, ["k"], states, at="at").count() == 0
    assert asof.before(probes, facts.limit(0), ["k"], states, at="at").filter("total IS NOT NULL").count() == 0


def test_features_before_a_season_are_those_of_the_earlier_results(spark):
    known = results(spark)
    got = {(r.season_year, r.driver_code): r.asDict() for r in h.features_before(asked(spark), known).collect()}
    for year in (2020, 2021, 2022, 2023, 2024):
        plain = h.historical_features(known.filter(F.col("season_year") < year))
        for r in plain.collect():
            other = got.pop((year, r.driver_code))
            for name, value in r.asDict().items():
                same = other[name] == value or isinstance(value, float) and math.isclose(value, other[name], abs_tol=1e-12)
                assert same, (year, name, value, other[name])
    assert got == {}


def test_a_season_does_not_see_itself_or_later_ones(spark):
    known = results(spark)
    entries = known.select("season_year", "round_number", "circuit_name", "driver_code").distinct()
    first = sc.confidence_before(entries, known).filter("season_year = 2020")
    assert {r.data_confidence for r in first.collect()} == {0.0}
    last = {r.driver_code: r.data_confidence for r in sc.confidence_before(entries, known).filter("season_year = 2023 and round_number = 1").collect()}
    assert last == {d: round(0.7 * 2 / 3 + 0.3 * 6 / 20, 2) for d in "ABCD"} | {"E": 0.0}
    more = known.unionByName(known.filter("season_year = 2023").withColumn("season_year", F.lit(2030)))
    again = {r.driver_code: r.data_confidence for r in sc.confidence_before(entries, more).filter("season_year = 2023 and round_number = 1").collect()}
    assert again == last


def test_pattern_scores_of_several_seasons_in_one_plan(spark):
    known = results(spark).withColumn("round_number", F.lit(1)).withColumn("circuit_name", F.lit("Ring"))
    known = known.unionByName(known.withColumn("season_year", F.col("season_year") - 10)).dropDuplicates(["season_year", "driver_code"])
    df = known.select("season_year", "round_number", "circuit_name", "driver_code").withColumns({"wins": F.lit(1), "current_form_score": F.lit(0.5)})
    seasons = {r.season_year for r in sc.pattern_score(df, known).select("season_year").distinct().collect()}
    # 2010, 2011, 2013, 2020, 2021, 2023: three races were held before 2020.
    assert seasons == {2020, 2021, 2023}


def test_teammates_of_every_season(spark):
    known = results(spark)
    drivers = asked(spark).filter("driver_code IN ('A', 'C', 'E', 'F')")
    standings = spark.createDataFrame([(2023, "Z", "E"), (2023, "Z", "F")], "season_year int, team string, driver_code string")
    roster = spark.createDataFrame([("Q", "F"), ("Q", "G"), ("X", "A"), ("X", "B")], "team string, driver_code string")
    got = {(r.season_year, r.driver_code): (r.teammate, r.teammate_source) for r in j.teammate_by_season(drivers, standings, known, roster).collect()}
    assert got[2020, "A"] == ("B", "roster") and got[2021, "A"] == ("B", "results") and got[2022, "C"] == ("D", "results")
    assert got[2023, "E"] == ("F", "standings") and got[2024, "E"] == ("C", "results") and got[2022, "E"] == (None, None)
    assert got[2022, "F"] == ("G", "roster")
    for year in (2021, 2023, 2024):
        plain = j.teammate(
            drivers.filter(F.col("season_year") == year).drop("season_year"), standings.filter(F.col("season_year") == year).drop("season_year"),
            known.filter(F.col("season_year") < year), roster,
        )
        assert {(r.driver_code, r.teammate, r.teammate_source) for r in plain.collect()} == {(d, *v) for (y, d), v in got.items() if y == year}


def test_standings_of_several_seasons(spark, rows):
    df = spark.createDataFrame([(2021, "A"), (2022, "A"), (2022, "B")], "season_year int, driver_code string")
    table = spark.createDataFrame([(2021, "A", 3, 9.0, "X"), (2022, "A", 1, 20.0, "Y")], "season_year int, driver_code string, position int, points double, team string")
    teams = spark.createDataFrame([(2021, "X", 4), (2022, "X", 2), (2022, "Y", 1)], "season_year int, team string, team_rank int")
    out = j.with_standings(df, table, teams, by=["season_year"])
    assert rows(out, "season_year", "driver_code", "championship_position", "current_team", "team_rank") == [
        (2021, "A", 3, "X", 4), (2022, "A", 1, "Y", 1), (2022, "B", 20, "Unknown", 10),
    ]
