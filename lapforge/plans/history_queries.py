"""Queries for the history analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import cleaning as c
from lapforge.operators import history as h
from lapforge.plans import bindings as b
from lapforge.plans import bindings_sql as s
from lapforge.plans.registry import query, rounded, rounded_sql

V = s.with_views
RESULTS = V(s.RESULTS)
WINNERS = V(s.RESULTS + ", winners AS (SELECT * FROM results WHERE finish_position = 1)")
RACES = """,
races AS (SELECT season_year, round_number, circuit_name, max(driver_code) FILTER (finish_position = 1) AS winner FROM results GROUP BY ALL)"""
WEATHER = s.RECORDS + """,
session_weather AS (
 SELECT season_year, round_number, circuit_name, session_type, avg(air_temp) AS air_temp_avg, avg(track_temp) AS track_temp_avg,
  avg(humidity) AS humidity_avg, avg(pressure) AS pressure_avg, avg(wind_speed) AS wind_speed_avg, bool_or(rainfall) AS rainfall, count(*) AS weather_records
 FROM weather_records GROUP BY ALL)"""
WEATHERED = V(s.RESULTS + RACES, WEATHER + """,
wx AS (SELECT r.*, w.air_temp_avg, w.rainfall FROM races r LEFT JOIN session_weather w USING (season_year, round_number))""")
CONS = "1 / (1 + stddev_pop({0}))"
N = "count(*) FILTER"
DIM = """,
dim AS (SELECT circuit_name, coalesce(qualifying_importance, 0.7) AS qi, coalesce(overtaking_difficulty, 'medium') AS od,
 coalesce(circuit_type, 'mixed') AS ct, coalesce(weather_sensitivity, 0.5) AS ws,
 CASE coalesce(overtaking_difficulty, 'medium') WHEN 'very_low' THEN 0.2 WHEN 'low' THEN 0.4 WHEN 'high' THEN 0.8 WHEN 'very_high' THEN 1.0 ELSE 0.6 END AS dr
 FROM circuit_dim)"""


@query("A10_winner_patterns", rounded_sql(WINNERS, f"""
SELECT circuit_name, count(*) AS races_won, avg(grid_position) AS avg_winning_grid, {N} (grid_position = 1) / count(grid_position) AS pole_win_rate,
 {N} (grid_position <= 2) / count(grid_position) AS front_row_win_rate FROM winners GROUP BY 1""", "avg_winning_grid pole_win_rate front_row_win_rate"))
def _(spark, d):
    return rounded(h.winner_patterns(b.results(spark, d)))


@query("A10_winners_by_year", WINNERS + "SELECT circuit_name, season_year, round_number, driver_code, team, grid_position FROM winners")
def _(spark, d):
    return h.winners_by_year(b.results(spark, d))


@query("A10_wins_by_driver", WINNERS + "SELECT circuit_name, driver_code, count(*) AS wins FROM winners GROUP BY ALL")
def _(spark, d):
    return h.wins_by(b.results(spark, d), "driver_code")


@query("A10_wins_by_team", WINNERS + "SELECT circuit_name, team, count(*) AS wins FROM winners GROUP BY ALL")
def _(spark, d):
    return h.wins_by(b.results(spark, d), "team")


@query("A11_qualifying_impact", rounded_sql(V(s.RESULTS, s.CIRCUITS + DIM), f"""
SELECT circuit_name, p AS pole_to_win_rate, f AS front_row_advantage, coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0) AS position_correlation,
 (coalesce(qi, 0.7) + (p + f) / 2) / 2 AS qualifying_importance_score
FROM (SELECT circuit_name, {N} (finish_position = 1 AND grid_position = 1) / nullif({N} (finish_position = 1), 0) AS p,
  {N} (finish_position = 1 AND grid_position <= 2) / nullif({N} (finish_position = 1), 0) AS f, corr(grid_position, finish_position) AS c
 FROM results GROUP BY 1) LEFT JOIN dim USING (circuit_name)""", "pole_to_win_rate front_row_advantage position_correlation qualifying_importance_score"))
def _(spark, d):
    return rounded(h.qualifying_impact(b.results(spark, d), b.circuit_dim(spark, d)))


@query("J03_with_circuit", V(s.RESULTS, s.CIRCUITS + DIM) + """
SELECT season_year, round_number, driver_code, coalesce(qi, 0.7) AS qualifying_importance, coalesce(od, 'medium') AS overtaking_difficulty,
 coalesce(ct, 'mixed') AS circuit_type, coalesce(ws, 0.5) AS weather_sensitivity FROM results LEFT JOIN dim USING (circuit_name)""")
def _(spark, d):
    out = h.with_circuit(b.results(spark, d), b.circuit_dim(spark, d))
    return out.select(*h.RACE, "driver_code", "qualifying_importance", "overtaking_difficulty", "circuit_type", "weather_sensitivity")


@query("A31_session_weather", rounded_sql(V(WEATHER), "SELECT * FROM session_weather", "air_temp_avg track_temp_avg humidity_avg pressure_avg wind_speed_avg"))
def _(spark, d):
    return rounded(h.session_weather(b.weather_records(spark, d)))


@query("A12_weather_impact", rounded_sql(WEATHERED, f"""
SELECT circuit_name, count(*) AS races, {N} (rainfall) AS wet_races, {N} (rainfall) / count(*) AS wet_race_share, {N} (air_temp_avg > 30) AS hot_races,
 {N} (air_temp_avg < 15) AS cold_races, {N} (air_temp_avg BETWEEN 15 AND 30) AS moderate_races FROM wx GROUP BY 1""", "wet_race_share"))
def _(spark, d):
    return rounded(h.weather_impact(b.results(spark, d), h.session_weather(b.weather_records(spark, d))))


@query("A12_rain_winners", WEATHERED + "SELECT circuit_name, winner AS driver_code, count(*) AS wet_wins FROM wx WHERE rainfall AND winner IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return h.rain_winners(b.results(spark, d), h.session_weather(b.weather_records(spark, d)))


@query("A23_weather_patterns", rounded_sql(WEATHERED, f"""
SELECT circuit_name, {N} (rainfall) / count(*) AS rain_frequency, avg(air_temp_avg) AS avg_temperature, min(air_temp_avg) AS min_temperature,
 max(air_temp_avg) AS max_temperature, var_pop(air_temp_avg) AS temperature_variance FROM wx GROUP BY 1""",
    "rain_frequency avg_temperature min_temperature max_temperature temperature_variance"))
def _(spark, d):
    return rounded(h.weather_patterns(b.results(spark, d), h.session_weather(b.weather_records(spark, d))))


@query("A13_team_performance", rounded_sql(RESULTS, f"""
SELECT circuit_name, team, count(*) AS total_entries, {N} (finish_position = 1) AS wins, {N} (finish_position <= 3) AS podiums,
 {N} (finish_position <= 10) AS points_finishes, avg(finish_position) AS avg_position, {CONS.format('finish_position')} AS consistency_score
FROM results GROUP BY ALL""", "avg_position consistency_score"))
def _(spark, d):
    return rounded(h.team_performance(b.results(spark, d)))


@query("A14_specialists", rounded_sql(RESULTS, f"""
SELECT circuit_name, driver_code, count(*) AS appearances, avg(finish_position) AS avg_position, min(finish_position) AS best_finish,
 {CONS.format('finish_position')} AS consistency_score, avg(grid_position) AS avg_quali_position, min(grid_position) AS best_quali
FROM results GROUP BY ALL HAVING count(*) >= 3""", "avg_position consistency_score avg_quali_position"))
def _(spark, d):
    return rounded(h.specialists(b.results(spark, d)))


@query("A15_overtaking", rounded_sql(WINNERS, f"""
SELECT circuit_name, coalesce(avg(grid_position - finish_position), 0) AS average_position_changes, {N} (grid_position > 5) AS comeback_victories,
 {N} (grid_position <= 2) / count(*) AS front_runner_dominance FROM winners GROUP BY 1""", "average_position_changes front_runner_dominance"))
def _(spark, d):
    return rounded(h.overtaking(b.results(spark, d)))


@query("A24_overtaking_stats", rounded_sql(V(s.RESULTS, s.CIRCUITS + DIM), f"""
SELECT circuit_name, coalesce(avg(grid_position - 1), 0) AS average_position_changes, {N} (grid_position <= 2) / count(*) AS front_runner_advantage,
 any_value(coalesce(od, 'medium')) AS comeback_difficulty, any_value(coalesce(dr, 0.6)) AS drs_zones_effectiveness
FROM results LEFT JOIN dim USING (circuit_name) WHERE finish_position = 1 GROUP BY 1""", "average_position_changes front_runner_advantage drs_zones_effectiveness"))
def _(spark, d):
    return rounded(h.overtaking_stats(b.results(spark, d), b.circuit_dim(spark, d)))


@query("A16_reliability", rounded_sql(RESULTS, f"""
SELECT circuit_name, driver_code, count(*) AS total_races, {N} (status <> 'Finished' AND finish_position IS NULL) AS dnfs,
 {N} (status <> 'Finished' AND finish_position IS NULL) / count(*) AS dnf_rate FROM results GROUP BY ROLLUP (circuit_name, driver_code)""", "dnf_rate"))
def _(spark, d):
    return rounded(h.reliability(b.results(spark, d)))


STATS = f""",
stats AS (
 SELECT circuit_name, driver_code, count(*) AS races, {N} (finish_position = 1) AS wins, {N} (finish_position <= 3) AS podiums,
  {N} (finish_position <= 10) AS points_finishes, {N} (finish_position IS NULL) AS dnfs, coalesce(avg(finish_position), 20) AS avg_position,
  coalesce({CONS.format('finish_position')}, 0) AS consistency, coalesce(avg(grid_position), 20) AS avg_quali_position,
  coalesce(min(grid_position), 20) AS best_quali, coalesce({CONS.format('grid_position')}, 0) AS quali_consistency,
  coalesce(avg(grid_position - finish_position), 0) AS avg_position_gain, coalesce(max(grid_position - finish_position), 0) AS best_comeback,
  coalesce({N} (grid_position > finish_position) / nullif(count(finish_position), 0), 0) AS comeback_frequency
 FROM results GROUP BY ALL)"""


@query("A17_driver_statistics", rounded_sql(V(s.RESULTS + STATS), "SELECT * FROM stats",
    "avg_position consistency avg_quali_position quali_consistency avg_position_gain comeback_frequency"))
def _(spark, d):
    return rounded(h.driver_statistics(b.results(spark, d)))


TEAMS = f""",
teams AS (
 SELECT circuit_name, team, count(*) AS races, {N} (finish_position = 1) AS wins, {N} (finish_position <= 3) AS podiums,
  {N} (finish_position <= 10) AS points_finishes, coalesce(avg(finish_position), 15) AS avg_position,
  coalesce({CONS.format('finish_position')}, 0) AS consistency, count(DISTINCT season_year) AS years_active
 FROM results GROUP BY ALL)"""


@query("A18_team_statistics", rounded_sql(V(s.RESULTS + TEAMS), "SELECT * FROM teams", "avg_position consistency"))
def _(spark, d):
    return rounded(h.team_statistics(b.results(spark, d)))


@query("A19_classify_specialists", rounded_sql(V(s.RESULTS + STATS), """
SELECT circuit_name, driver_code, 'race_winner' AS class, wins / races * 0.6 + podiums / races * 0.4 AS score FROM stats WHERE races >= 3 AND wins / races >= 0.3
UNION ALL SELECT circuit_name, driver_code, 'consistent_performer', 1.0 - dnfs / races FROM stats WHERE races >= 3 AND points_finishes / races >= 0.7
UNION ALL SELECT circuit_name, driver_code, 'qualifying_master', avg_quali_position FROM stats WHERE races >= 3 AND avg_quali_position <= 5
UNION ALL SELECT circuit_name, driver_code, 'comeback_specialist', avg_position_gain FROM stats WHERE races >= 3 AND avg_position_gain > 2""", "score"))
def _(spark, d):
    return rounded(h.classify_specialists(h.driver_statistics(b.results(spark, d))))


@query("A20_dominant_teams", rounded_sql(V(s.RESULTS + TEAMS.replace("SELECT circuit_name, team,", "SELECT circuit_name, driver_code AS team,")), """
SELECT circuit_name, team, avg_position, wins / races AS win_rate, podiums / races AS podium_rate FROM teams
WHERE races >= 3 AND (wins / races > 0.2 OR podiums / races > 0.4)""", "avg_position win_rate podium_rate"))
def _(spark, d):
    # Every driver is their own team here, so that some teams do dominate.
    solo = b.results(spark, d).withColumn("team", F.col("driver_code"))
    return rounded(h.dominant_teams(h.team_statistics(solo)))


OVERVIEW = """
SELECT circuit_name, count(*) AS total_races, array_to_string(list_sort(list_distinct(list(season_year))), ',') AS years_covered,
 coalesce(count(DISTINCT winner) / nullif(count(winner), 0), 0) AS winner_diversity FROM races GROUP BY 1"""


def overview(spark, d):
    out = h.history_overview(b.results(spark, d))
    return rounded(out.withColumn("years_covered", F.array_join(F.col("years_covered").cast("array<string>"), ",")))


@query("A21_history_overview", rounded_sql(V(s.RESULTS + RACES), OVERVIEW, "winner_diversity"))
def _(spark, d):
    return overview(spark, d)


@query("A26_quality_tier", V(s.RESULTS + RACES) + f"""
SELECT circuit_name, total_races, CASE WHEN total_races >= 7 THEN 'excellent' WHEN total_races >= 5 THEN 'good' WHEN total_races >= 3 THEN 'fair' ELSE 'limited' END AS data_quality
FROM ({OVERVIEW})""")
def _(spark, d):
    return h.quality_tier(overview(spark, d)).select("circuit_name", "total_races", "data_quality")


@query("A22_success_patterns", rounded_sql(WINNERS, f"""
SELECT circuit_name, avg(grid_position) AS avg_starting_position, {N} (grid_position > 3) AS upset_victories,
 {N} (grid_position = 1) / count(grid_position) * 100 AS pole_win_percentage, {N} (grid_position <= 2) / count(grid_position) * 100 AS front_row_win_percentage,
 {N} (grid_position <= 5) / count(grid_position) * 100 AS top_5_win_percentage FROM winners GROUP BY 1""",
    "avg_starting_position pole_win_percentage front_row_win_percentage top_5_win_percentage"))
def _(spark, d):
    return rounded(h.success_patterns(b.results(spark, d)))


@query("A25_circuit_difficulty", rounded_sql(V(s.RESULTS + RACES, s.CIRCUITS + DIM), """
SELECT circuit_name, u AS unpredictability_factor, coalesce(dr, 0.6) * 0.3 + coalesce(qi, 0.7) * 0.25 + coalesce(ws, 0.5) * 0.2 + u * 0.25 AS overall_rating
FROM (SELECT circuit_name, (count(DISTINCT winner) / count(*) + count(*) FILTER (grid_position > 3) / count(*)) / 2 AS u
 FROM races LEFT JOIN (SELECT season_year, round_number, grid_position FROM results WHERE finish_position = 1) USING (season_year, round_number) GROUP BY 1)
LEFT JOIN dim USING (circuit_name)""", "unpredictability_factor overall_rating"))
def _(spark, d):
    return rounded(h.circuit_difficulty(b.results(spark, d), b.circuit_dim(spark, d)))


@query("A27_historical_features", rounded_sql(RESULTS, f"""
SELECT driver_code, coalesce(avg(finish_position), 12) AS historical_avg_position, CAST(coalesce(min(finish_position), 15) AS DOUBLE) AS historical_best_position,
 coalesce({CONS.format('finish_position')}, 0.5) AS historical_consistency, coalesce({N} (finish_position = 1) / nullif(count(finish_position), 0), 0) AS historical_win_rate,
 coalesce({N} (finish_position <= 3) / nullif(count(finish_position), 0), 0) AS historical_podium_rate,
 coalesce({N} (finish_position <= 10) / nullif(count(finish_position), 0), 0.3) AS historical_points_rate,
 coalesce(avg(grid_position), 12) AS historical_quali_avg, CAST(coalesce(min(grid_position), 15) AS DOUBLE) AS historical_quali_best,
 count(*) AS circuit_race_count, least(count(*) / 5.0, 1.0) AS circuit_experience, {N} (finish_position IS NULL) / count(*) AS circuit_dnf_rate,
 sum(points) AS historical_total_points FROM results GROUP BY 1""",
    "historical_avg_position historical_best_position historical_consistency historical_win_rate historical_podium_rate historical_points_rate "
    "historical_quali_avg historical_quali_best circuit_experience circuit_dnf_rate historical_total_points"))
def _(spark, d):
    return rounded(h.historical_features(b.results(spark, d)))


@query("A32_constructor_standings", V(s.RESULTS, s.STANDINGS) + "SELECT season_year, series, team, sum(points) AS points FROM standings GROUP BY ALL")
def _(spark, d):
    return h.constructor_standings(b.standings(spark, d), ["season_year", "series"])


@query("A33_win_counts", V(s.RESULTS, s.ROSTER) + "SELECT driver_code, count(*) AS wins FROM results WHERE finish_position = 1 AND driver_code IN (SELECT driver_code FROM active) GROUP BY 1")
def _(spark, d):
    return h.win_counts(b.results(spark, d), b.active(spark, d))


@query("A35_data_confidence", RESULTS + f"""
SELECT driver_code, round(0.7 * least(1.0, {N} (lower(circuit_name) LIKE '%circuit 1%') / 3) + 0.3 * least(1.0, count(*) / 20), 2) AS data_confidence
FROM results GROUP BY 1""")
def _(spark, d):
    return h.data_confidence(b.results(spark, d), "Circuit 1")


@query("W14_substitute_winner", V(s.RESULTS + RACES, s.ROSTER) + """
SELECT season_year, round_number, circuit_name, winner, CASE WHEN winner IS NOT NULL THEN best END AS active_winner FROM races
LEFT JOIN (SELECT season_year, round_number, arg_min(driver_code, finish_position) AS best FROM results
 WHERE finish_position IS NOT NULL AND driver_code IN (SELECT driver_code FROM active) GROUP BY ALL) USING (season_year, round_number)""")
def _(spark, d):
    return h.substitute_winner(b.results(spark, d), b.active(spark, d))


@query("P07_filter_active", V(s.RESULTS, s.ROSTER) + "SELECT season_year, round_number, driver_code FROM results WHERE driver_code IN (SELECT driver_code FROM active)")
def _(spark, d):
    return c.filter_active(b.results(spark, d), b.active(spark, d)).select(*h.RACE, "driver_code")


@query("J13_filter_absent", V(s.RESULTS, s.ROSTER) + "SELECT season_year, round_number, driver_code FROM results WHERE driver_code NOT IN (SELECT driver_code FROM active)")
def _(spark, d):
    return c.filter_absent(b.results(spark, d), b.active(spark, d)).select(*h.RACE, "driver_code")


@query("A37_roster_breakdown", V(s.ROSTER) + "SELECT series, count(*) FILTER (NOT is_rookie) AS experienced_drivers, count(*) FILTER (is_rookie) AS rookie_drivers, count(*) AS total_active_drivers FROM active GROUP BY 1")
def _(spark, d):
    return h.roster_breakdown(b.active(spark, d), ["series"])
