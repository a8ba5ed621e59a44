"""Queries for joins and the scoring rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapforge import constants as k
from lapforge.operators import history as h
from lapforge.operators import joins as j
from lapforge.operators import laps as l
from lapforge.operators import resolve as r
from lapforge.operators import scoring as sc
from lapforge.plans import bindings as b
from lapforge.plans import bindings_sql as s
from lapforge.plans.history_queries import CONS, DIM, N, WEATHER
from lapforge.plans.laps_queries import NEAR
from lapforge.plans.registry import query, rounded, rounded_sql
from lapforge.session import joins_by_some_keys

V = s.with_views
RESULTS = V(s.RESULTS)

# Teams carry names of the strength table, by position; the last two are not in it.
NAMES = [*k.TEAM_STRENGTH, "Haas Racing", "Nobody Racing"]
NAME_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
STRENGTH = " ".join(f"WHEN '{n}' THEN {v}" for n, v in {**k.TEAM_STRENGTH, "Haas Racing": 0.05}.items())


def named_team(df, number="driver_number"):
    index = (F.col(number) % len(NAMES) + 1).cast("int")
    return df.withColumn("team", F.element_at(F.array(*[F.lit(n) for n in NAMES]), index))


def team_ranks(spark, d):
    """Rank of each team in its series, for the season that the championship applies to; a series has ten teams."""
    points = b.championship(spark, d).groupBy("season_year", "series", "team").agg(F.sum("points").alias("points"))
    order = Window.partitionBy("season_year", "series").orderBy(F.col("points").desc(), "team")
    return points.withColumn("team_rank", F.row_number().over(order)).select("season_year", "team", "team_rank")


RANKS = """,
team_ranks AS (SELECT season_year, team, CAST(row_number() OVER (PARTITION BY season_year, series ORDER BY sum(points) DESC, team) AS INTEGER) AS team_rank
 FROM championship GROUP BY season_year, series, team)"""
BASE = V(s.RESULTS, s.STANDINGS, s.ROSTER, s.DRIVERS)
RACE_KEY = "season_year, round_number, driver_code"


@query("J11_scaffold", rounded_sql(BASE, """
SELECT d.season_year, d.driver_code, coalesce(avg(finish_position), 12) AS historical_avg_position, count(h.driver_code) AS circuit_race_count
FROM drivers d LEFT JOIN (SELECT * FROM results WHERE finish_position = 1) h ON d.driver_code = h.driver_code AND h.season_year < d.season_year
GROUP BY ALL""", "historical_avg_position"))
def _(spark, d):
    # Records of winners only, so that the others get the defaults.
    roster, columns = b.drivers(spark, d), ["historical_avg_position", "circuit_race_count"]
    facts = h.features_before(roster, h.winners(b.results(spark, d))).select("season_year", "driver_code", *columns)
    out = j.scaffold(roster, facts, dict(zip(columns, (12.0, 0), strict=True)), keys=("season_year", "driver_code"))
    return rounded(out.select("season_year", "driver_code", *columns))


@query("A27_features_before", rounded_sql(BASE, f"""
SELECT d.season_year, d.driver_code, coalesce(avg(finish_position), 12) AS historical_avg_position, coalesce(min(finish_position), 15)::DOUBLE AS historical_best_position,
 CASE WHEN count(finish_position) > 0 THEN {CONS.format('finish_position')} ELSE 0.5 END AS historical_consistency,
 coalesce({N} (finish_position = 1) / nullif(count(finish_position), 0), 0) AS historical_win_rate,
 coalesce({N} (finish_position <= 3) / nullif(count(finish_position), 0), 0) AS historical_podium_rate,
 coalesce({N} (finish_position <= 10) / nullif(count(finish_position), 0), 0.3) AS historical_points_rate,
 avg(grid_position) AS historical_quali_avg, min(grid_position)::DOUBLE AS historical_quali_best, count(*) AS circuit_race_count,
 least(count(*) / 5, 1.0) AS circuit_experience, {N} (finish_position IS NULL) / count(*) AS circuit_dnf_rate, sum(points) AS historical_total_points
FROM drivers d JOIN results h ON d.driver_code = h.driver_code AND h.season_year < d.season_year GROUP BY ALL""",
    "historical_avg_position historical_best_position historical_consistency historical_win_rate historical_podium_rate historical_points_rate "
    "historical_quali_avg historical_quali_best circuit_experience circuit_dnf_rate historical_total_points"))
def _(spark, d):
    """Every driver's record as it stood before each season."""
    return rounded(h.features_before(b.drivers(spark, d), b.results(spark, d)))


WITH_ST = """,
st AS (SELECT r.season_year, r.driver_code, r.is_rookie, r.series, coalesce(s.position, 20) AS championship_position, coalesce(s.points, 0) AS championship_points,
  coalesce(s.team, 'Unknown') AS current_team, coalesce(t.team_rank, 10) AS team_rank
 FROM drivers r LEFT JOIN championship s USING (season_year, driver_code) LEFT JOIN team_ranks t ON t.team = s.team AND t.season_year = r.season_year)"""
ST = V(s.RESULTS, s.STANDINGS + RANKS, s.ROSTER, s.DRIVERS + WITH_ST)


def with_standings(spark, d):
    """Every active driver of every season, with the standings that the season starts from."""
    drivers = b.drivers(spark, d).drop("team")
    return j.with_standings(drivers, b.championship(spark, d), team_ranks(spark, d), by=["season_year"])


@query("J04_with_standings", ST + "SELECT season_year, driver_code, championship_position, championship_points, current_team, team_rank FROM st")
def _(spark, d):
    return with_standings(spark, d).select("season_year", "driver_code", "championship_position", "championship_points", "current_team", "team_rank")


@query("M01_form_score", rounded_sql(ST, """
SELECT season_year, driver_code, is_rookie, CASE WHEN is_rookie AND championship_position <= 8 THEN 0.7 + 0.2 * (9 - championship_position) / 8
 WHEN is_rookie AND championship_position <= 15 THEN 0.4 + 0.3 * (16 - championship_position) / 7
 WHEN is_rookie THEN 0.2 + 0.2 * (21 - championship_position) / 5 ELSE greatest(0.1, (21 - championship_position) / 20) END AS current_form_score FROM st""", "current_form_score"))
def _(spark, d):
    return rounded(sc.form_score(with_standings(spark, d)).select("season_year", "driver_code", "is_rookie", "current_form_score"))


@query("M02_team_momentum", rounded_sql(ST, """
SELECT season_year, driver_code, greatest(0.1, (11 - team_rank) / 10) AS current_team_performance,
 CASE WHEN championship_points > 50 THEN 0.8 WHEN championship_points > 20 THEN 0.6 ELSE 0.4 END AS recent_momentum FROM st""", "current_team_performance recent_momentum"))
def _(spark, d):
    out = sc.team_momentum(with_standings(spark, d))
    return rounded(out.select("season_year", "driver_code", "current_team_performance", "recent_momentum"))


@query("A28_rookie_features", rounded_sql(V(s.RESULTS, s.STANDINGS), f"""
SELECT season_year, driver_code, coalesce(a, least(position + 2, 20)) AS historical_avg_position, coalesce(m, greatest(1, position - 5)) AS historical_best_position,
 coalesce(c, 0.5) AS historical_consistency, coalesce(p3, CASE WHEN position <= 10 THEN 0.1 ELSE 0 END) AS historical_podium_rate,
 coalesce(p10, CASE WHEN points > 0 THEN 0.3 ELSE 0 END) AS historical_points_rate, least(coalesce(a, least(position + 2, 20)) + 1, 20) AS historical_quali_avg,
 points AS historical_total_points, coalesce(n, 0) AS season_races
FROM championship LEFT JOIN (SELECT season_year, driver_code, avg(finish_position) AS a, min(finish_position) AS m, {CONS.format('finish_position')} AS c, count(finish_position) AS n,
  {N} (finish_position <= 3) / nullif(count(finish_position), 0) AS p3, {N} (finish_position <= 10) / nullif(count(finish_position), 0) AS p10
 FROM results GROUP BY 1, 2) USING (season_year, driver_code)""",
    "historical_avg_position historical_best_position historical_consistency historical_podium_rate historical_points_rate historical_quali_avg historical_total_points"))
def _(spark, d):
    keep = ["season_year", "driver_code", "historical_avg_position", "historical_best_position", "historical_consistency",
            "historical_podium_rate", "historical_points_rate", "historical_quali_avg", "historical_total_points", "season_races"]
    return rounded(rookies(spark, d).select(*keep))


def rookies(spark, d):
    return sc.rookie_features(b.results(spark, d), b.championship(spark, d), by=["season_year"])


SUMMARY = NEAR + """,
summary AS (SELECT season_year, round_number, session_type, driver_code, count(*) AS total_laps, any_value(valid_laps) AS valid_laps,
  min(lap_time_seconds) AS fastest_lap, avg(lap_time_seconds) AS average_lap, any_value(consistency) AS consistency
 FROM laps JOIN cons USING (season_year, round_number, session_type, driver_code) GROUP BY ALL),
quali AS (SELECT season_year, round_number, driver_code, min(lap_time_seconds) AS qualifying_time FROM timed_laps WHERE session_type = 'FP1' GROUP BY ALL)"""


@query("J02_driver_weekend", rounded_sql(V(s.RESULTS.replace(s.LAPS, s.TIMED_LAPS, 1) + SUMMARY), """
SELECT r.season_year, r.round_number, r.driver_code, r.finish_position, q.qualifying_time, a.total_laps AS race_total_laps, a.average_lap AS race_average_lap,
 f.valid_laps AS fp1_valid_laps, f.fastest_lap AS fp1_fastest_lap, f.consistency AS fp1_consistency
FROM results r LEFT JOIN quali q USING (season_year, round_number, driver_code)
LEFT JOIN (SELECT * FROM summary WHERE session_type = 'RACE') a USING (season_year, round_number, driver_code)
LEFT JOIN (SELECT * FROM summary WHERE session_type = 'FP1') f USING (season_year, round_number, driver_code)""",
    "qualifying_time race_average_lap fp1_fastest_lap fp1_consistency"))
def _(spark, d):
    laps = b.laps(spark, d)
    summaries = l.session_summary(laps.withColumn("position", F.lit(None).cast("int")))
    practice = b.timed_laps(spark, d).filter("session_type = 'FP1'")
    quali = practice.groupBy(*j.RACE, "driver_code").agg(F.min("lap_time_seconds").alias("qualifying_time"))
    out = j.driver_weekend(b.results(spark, d), quali, summaries, ["RACE", "FP1"])
    return rounded(out.select(
        *j.RACE, "driver_code", "finish_position", "qualifying_time", "race_total_laps", "race_average_lap",
        "fp1_valid_laps", "fp1_fastest_lap", "fp1_consistency"))


MATES = """,
m1 AS (SELECT a.season_year, a.driver_code, min(b.driver_code) AS t1 FROM (SELECT * FROM championship WHERE points > 0) a
  JOIN (SELECT * FROM championship WHERE points > 0) b ON a.season_year = b.season_year AND a.team = b.team AND a.driver_code <> b.driver_code GROUP BY 1, 2),
shared AS (SELECT a.driver_code, a.season_year, a.round_number, min(b.driver_code) AS t FROM results a JOIN results b
   ON a.season_year = b.season_year AND a.round_number = b.round_number AND a.team = b.team AND a.driver_code <> b.driver_code GROUP BY ALL),
m2 AS (SELECT d.season_year, d.driver_code, arg_max(t, s.season_year * 1000000 + s.round_number) AS t2
  FROM drivers d JOIN shared s ON s.driver_code = d.driver_code AND s.season_year < d.season_year GROUP BY 1, 2),
m3 AS (SELECT a.driver_code, min(b.driver_code) AS t3 FROM active a JOIN active b ON a.team = b.team AND a.driver_code <> b.driver_code GROUP BY 1),
mates AS (SELECT season_year, driver_code, coalesce(t1, t2, t3) AS teammate, CASE WHEN t1 IS NOT NULL THEN 'standings' WHEN t2 IS NOT NULL THEN 'results' WHEN t3 IS NOT NULL THEN 'roster' END AS teammate_source
 FROM drivers LEFT JOIN m1 USING (season_year, driver_code) LEFT JOIN m2 USING (season_year, driver_code) LEFT JOIN m3 USING (driver_code))"""


def mates(spark, d):
    """The standings list drivers with points; the others have raced before."""
    table = b.championship(spark, d).filter("points > 0")
    return j.teammate_by_season(b.drivers(spark, d), table, b.results(spark, d), b.active(spark, d))


@query("J05_teammate", V(s.RESULTS, s.STANDINGS, s.ROSTER, s.DRIVERS + MATES) + "SELECT * FROM mates")
def _(spark, d):
    return mates(spark, d).select("season_year", "driver_code", "teammate", "teammate_source")


@query("J09_with_grid", V(s.RESULTS, s.ROSTER) + """
SELECT a.season_year, a.round_number, a.driver_code, a.team, b.grid_position FROM results a LEFT JOIN
 (SELECT season_year, round_number, driver_code, grid_position FROM results WHERE finish_position IS NOT NULL) b USING (season_year, round_number, driver_code)""")
def _(spark, d):
    res = b.results(spark, d)
    slots = res.filter("finish_position IS NOT NULL").select(
        *j.RACE, F.lower("driver_code").alias("driver"), F.col("grid_position").alias("position"))
    out = j.with_grid(res.drop("grid_position"), slots)
    return out.select(*j.RACE, "driver_code", "team", "grid_position")


@query("J09_with_grid_substring", V(s.RESULTS) + """
SELECT a.season_year, a.round_number, a.driver_code, min(b.grid_position) AS grid_position FROM results a LEFT JOIN
 (SELECT season_year, round_number, CASE WHEN driver_number % 2 = 0 THEN 'DRIVER ' || driver_code || ' (' || team || ')' ELSE substring(driver_code, 8, 3) END AS driver, grid_position FROM results) b
 ON a.season_year = b.season_year AND a.round_number = b.round_number AND (contains(a.driver_code, b.driver) OR contains(b.driver, a.driver_code)) GROUP BY ALL""")
def _(spark, d):
    res = b.results(spark, d)
    label = F.concat(F.lit("driver "), F.col("driver_code"), F.lit(" ("), F.col("team"), F.lit(")"))
    driver = F.when(F.col("driver_number") % 2 == 0, label).otherwise(F.substring("driver_code", 8, 3))
    slots = res.select(*j.RACE, driver.alias("driver"), F.col("grid_position").alias("position"))
    out = j.with_grid(res.drop("grid_position"), slots, substring=True)
    return out.select(*j.RACE, "driver_code", "grid_position")


@query("J10_combine_scores", rounded_sql(RESULTS, """
SELECT season_year, round_number, driver_code, a.points * 0.7 + coalesce(b.v, 0) * 0.3 AS score
FROM results a LEFT JOIN (SELECT season_year, round_number, driver_code, 1.0 / grid_position AS v FROM results WHERE finish_position IS NOT NULL) b USING (season_year, round_number, driver_code)""", "score"))
def _(spark, d):
    res = b.results(spark, d)
    right = res.filter("finish_position IS NOT NULL").withColumn("v", 1.0 / F.col("grid_position"))
    keys = [*j.RACE, "driver_code"]
    return rounded(j.combine_scores(res, right, keys, "points", "v").select(*keys, "score"))


# --- the full model -------------------------------------------------------------------
# Rain drivers are the first ten of the championship, heat drivers those with a high
# number, specialists those on the first ten grid slots, overtakers those from 11 on.
RAIN = lambda: F.col("championship_position") <= 10
HEAT = lambda: F.col("driver_code") > "D000000050"
SPECIALIST = lambda: F.coalesce(F.col("configured_importance") > 0.7, F.lit(False))
OVERTAKER = lambda: F.col("team_rank") <= 5


def entries(spark, d):
    """Every active driver for every race of the season, with all that is known beforehand."""
    with joins_by_some_keys(spark):
        return b.staged_as(spark, d, "entries", lambda: lazy_entries(spark, d))


def lazy_entries(spark, d):
    # What is known of a race or of a driver's season is joined to those before they multiply.
    res = b.results(spark, d)
    place = [*j.RACE, "series", "driver_code"]
    grid = res.filter("finish_position IS NOT NULL").select(*place, "grid_position")
    rounds = h.with_circuit(res.select(*j.RACE, "circuit_name", "series").distinct(), b.circuit_dim(spark, d))
    sky = h.session_weather(b.weather_records(spark, d)).select(
        *j.RACE, F.col("air_temp_avg").alias("temperature"), (F.col("humidity_avg") % 70).alias("rain_probability"))
    last_year = (F.col("season_year") + 1).alias("season_year")
    quali = res.groupBy(last_year, "driver_code").agg(F.avg("grid_position").alias("avg_quali_position"))
    key = ["season_year", "driver_code"]
    drivers = with_standings(spark, d).join(mates(spark, d).select(*key, "teammate"), key)
    number = F.substring("driver_code", 2, 9).cast("long")
    drivers = drivers.withColumn("driver_number", number)
    drivers = named_team(drivers).withColumn("current_team", F.col("team")).drop("team", "driver_number")
    drivers = drivers.join(quali, key, "left")
    return rounds.join(sky, j.RACE, "left").join(drivers, ["season_year", "series"]).join(grid, place, "left")


def features(spark, d):
    """The model's feature table."""
    with joins_by_some_keys(spark):
        return b.staged_as(spark, d, "features", lambda: lazy_features(spark, d))


def lazy_features(spark, d):
    known = b.results(spark, d)
    return sc.prediction_features(entries(spark, d), known, rookies(spark, d), RAIN(), HEAT(), SPECIALIST(), OVERTAKER())


MODEL = f""",
rounds AS (SELECT DISTINCT season_year, round_number, circuit_name, series, qi AS raw_qi, od AS raw_od, ws FROM results LEFT JOIN (
  SELECT circuit_name, qualifying_importance AS qi, coalesce(overtaking_difficulty, 'medium') AS od, weather_sensitivity AS ws FROM circuit_dim) USING (circuit_name)),
qlast AS (SELECT season_year + 1 AS season_year, driver_code, avg(grid_position) AS avg_quali FROM results GROUP BY 1, 2),
ent AS (SELECT x.round_number, x.circuit_name, st.*, {NAME_LIST}[CAST(substring(st.driver_code, 2) AS BIGINT) % {len(NAMES)} + 1] AS tname, mates.teammate,
  raw_qi, coalesce(raw_qi, 0.7) AS qi, coalesce(raw_od, 'medium') AS od, g.grid_position AS grid, w.air_temp_avg AS temp, w.humidity_avg % 70 AS rain, qlast.avg_quali
 FROM rounds x JOIN st ON st.series = x.series AND st.season_year = x.season_year JOIN mates ON mates.driver_code = st.driver_code AND mates.season_year = st.season_year
 LEFT JOIN (SELECT * FROM results WHERE finish_position IS NOT NULL) g ON g.season_year = x.season_year AND g.round_number = x.round_number AND g.driver_code = st.driver_code
 LEFT JOIN session_weather w ON w.season_year = x.season_year AND w.round_number = x.round_number
 LEFT JOIN qlast ON qlast.driver_code = st.driver_code AND qlast.season_year = st.season_year),
held AS (SELECT x.season_year, x.circuit_name, count(DISTINCT (h.season_year, h.round_number)) AS held
 FROM (SELECT DISTINCT season_year, circuit_name FROM rounds) x JOIN results h ON h.circuit_name = x.circuit_name AND h.season_year < x.season_year GROUP BY ALL),
past AS (SELECT x.season_year, x.circuit_name, h.driver_code, coalesce(avg(finish_position), 12) AS ap, coalesce({CONS.format('finish_position')}, 0.5) AS co, count(*) AS n, least(count(*) / 5.0, 1.0) AS ex,
  count(*) FILTER (finish_position = 1) AS wins
 FROM (SELECT DISTINCT season_year, circuit_name FROM rounds) x JOIN results h ON h.circuit_name = x.circuit_name AND h.season_year < x.season_year GROUP BY ALL),
career AS (SELECT d.season_year, d.driver_code, count(*) AS n FROM drivers d JOIN results h ON h.driver_code = d.driver_code AND h.season_year < d.season_year GROUP BY ALL),
rook AS (SELECT season_year, driver_code, coalesce(a, least(position + 2, 20)) AS ap, coalesce(c, 0.5) AS co FROM championship
  LEFT JOIN (SELECT season_year, driver_code, avg(finish_position) AS a, {CONS.format('finish_position')} AS c FROM results GROUP BY 1, 2) USING (season_year, driver_code)),
conf AS (SELECT e.*, round(0.7 * least(1.0, coalesce(p.n, 0) / 3) + 0.3 * least(1.0, coalesce(c.n, 0) / 20), 2) AS data_confidence,
  coalesce(p.ap, 12) AS oap, coalesce(p.co, 0.5) AS oco, coalesce(p.ex, 0) AS oex, coalesce(p2.ap, 12) AS map, coalesce(p2.co, 0.5) AS mco, coalesce(p2.ex, 0) AS mex,
  coalesce(rook.ap, 12) AS rap, coalesce(rook.co, 0.5) AS rco, coalesce(p.wins, 0) AS wins
 FROM ent e LEFT JOIN past p ON p.season_year = e.season_year AND p.circuit_name = e.circuit_name AND p.driver_code = e.driver_code
 LEFT JOIN career c ON c.season_year = e.season_year AND c.driver_code = e.driver_code
 LEFT JOIN past p2 ON p2.season_year = e.season_year AND p2.circuit_name = e.circuit_name AND p2.driver_code = e.teammate
 LEFT JOIN rook ON rook.season_year = e.season_year AND rook.driver_code = e.driver_code),
base AS (SELECT *, is_rookie OR data_confidence < 0.4 AS proxy,
  CASE WHEN is_rookie AND championship_position <= 8 THEN 0.7 + 0.2 * (9 - championship_position) / 8 WHEN is_rookie AND championship_position <= 15 THEN 0.4 + 0.3 * (16 - championship_position) / 7
   WHEN is_rookie THEN 0.2 + 0.2 * (21 - championship_position) / 5 ELSE greatest(0.1, (21 - championship_position) / 20) END AS current_form_score,
  greatest(0.1, (11 - team_rank) / 10) AS current_team_performance,
  CASE WHEN championship_points > 50 THEN 0.8 WHEN championship_points > 20 THEN 0.6 ELSE 0.4 END AS recent_momentum,
  CASE WHEN grid IS NOT NULL THEN greatest(0.05, (21 - grid) / 20) * coalesce(raw_qi, 0.85) ELSE 0 END AS qualifying_advantage,
  CASE WHEN grid = 1 THEN 0.25 ELSE 0 END AS pole_position_bonus, CASE WHEN grid = 2 THEN 0.15 ELSE 0 END AS front_row_bonus,
  CASE WHEN grid BETWEEN 3 AND 5 THEN 0.1 ELSE 0 END AS top_5_bonus, coalesce(avg_quali, 15) AS avg_quali_position, CAST(coalesce(grid, 20) AS INTEGER) AS grid_position,
  temp IS NOT NULL OR rain IS NOT NULL AS sky, championship_position <= 10 AS rainy, driver_code > 'D000000050' AS heaty, coalesce(raw_qi > 0.7, false) AS special, team_rank <= 5 AS passer
 FROM conf),
feat AS (SELECT *, CASE WHEN NOT proxy THEN oap WHEN teammate IS NOT NULL THEN least(20, map + 2) ELSE rap END AS historical_avg_position,
  CASE WHEN NOT proxy THEN oco WHEN teammate IS NOT NULL THEN greatest(0.1, mco * 0.8) ELSE rco END AS historical_consistency,
  CASE WHEN NOT proxy THEN oex WHEN teammate IS NOT NULL THEN mex ELSE 0 END AS circuit_experience,
  CASE WHEN proxy AND teammate IS NULL THEN 0.15 ELSE 0 END AS rookie_penalty,
  CASE WHEN sky AND rainy AND coalesce(rain, 0) > 30 THEN least(rain / 100, 0.3) ELSE 0 END AS rain_specialist,
  CASE WHEN sky AND coalesce(temp, 25) > 30 THEN CASE WHEN heaty THEN 0.8 ELSE 0.3 END ELSE 0.5 END AS heat_tolerance,
  CASE WHEN sky AND coalesce(temp, 25) > 30 AND NOT heaty THEN 0.1 ELSE 0 END + CASE WHEN sky AND is_rookie THEN 0.1 ELSE 0 END AS weather_risk_factor,
  CASE WHEN special THEN CASE WHEN is_rookie THEN 0.1 ELSE 0.2 END ELSE 0 END AS circuit_type_advantage,
  CASE WHEN od IN ('high', 'very_high') AND passer THEN CASE WHEN is_rookie THEN 0.05 ELSE 0.15 END ELSE 0 END AS overtaking_advantage,
  CASE WHEN is_rookie THEN 0 ELSE least(wins * 0.1, 0.3) END AS historical_winner_bonus
 FROM base),
feat2 AS (SELECT *, 0.5 + rain_specialist + CASE WHEN sky AND coalesce(temp, 25) > 30 AND heaty THEN 0.1 ELSE 0 END AS weather_advantage,
  CASE WHEN grid_position < 20 THEN CAST(grid_position AS DOUBLE) ELSE avg_quali_position END AS expected_quali_position FROM feat),
feat3 AS (SELECT *, least(20, greatest(1, expected_quali_position * qi + historical_avg_position * (1 - qi) - qualifying_advantage * 10 + CASE WHEN is_rookie THEN rookie_penalty * 3 ELSE 0 END)) AS expected_race_position,
  least(1, greatest(0, (current_form_score * 0.4 + (21 - historical_avg_position) / 20 * 0.2 + weather_advantage * 0.1 + circuit_experience * 0.05 + qualifying_advantage * 0.25) * CASE WHEN is_rookie THEN 0.9 ELSE 1 END)) AS competitiveness_score
 FROM feat2),
scored AS (SELECT *, qi * CASE WHEN grid_position = 1 THEN 0.4 WHEN grid_position = 2 THEN 0.25 WHEN grid_position = 3 THEN 0.15 WHEN grid_position <= 5 THEN 0.1 WHEN grid_position <= 10 THEN 0.05 ELSE 0 END AS grid_boost,
  CASE tname {STRENGTH} ELSE 0.01 END AS team_advantage FROM feat3),
mains AS (SELECT *, greatest(0.01, least(0.95, ((21 - championship_position) / 20 * 0.4 + (21 - historical_avg_position) / 20 * 0.2 + grid_boost * 0.25 + circuit_type_advantage * 0.1 + team_advantage * 0.05)
   * CASE WHEN is_rookie THEN 0.85 ELSE 1 END)) AS m0,
  held FROM scored LEFT JOIN held USING (season_year, circuit_name)),
pats AS (SELECT *, m0 / sum(m0) OVER w AS main_score, CASE WHEN held >= 3 THEN greatest(0.01, least(0.99, (0.5 + wins / held * 0.3) * (0.5 + current_form_score))) END AS p0 FROM mains WINDOW w AS (PARTITION BY season_year, round_number)),
predicted AS (SELECT *, p0 / sum(p0) OVER w AS pattern_score, (main_score * 0.7 + coalesce(p0 / sum(p0) OVER w, 0) * 0.3) * 100 AS win_probability FROM pats WINDOW w AS (PARTITION BY season_year, round_number)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY season_year, round_number ORDER BY win_probability DESC, driver_code) AS INTEGER) AS rank FROM predicted)"""
MODEL_SQL = V(s.RESULTS.replace("ranked AS", "places AS").replace("FROM ranked)", "FROM places)"), s.STANDINGS + RANKS, s.ROSTER, s.DRIVERS + WITH_ST + MATES, s.CIRCUITS, WEATHER + MODEL)


def model_query(name, columns, doubles, view, build):
    sql = rounded_sql(MODEL_SQL, f"SELECT {RACE_KEY}, {', '.join(columns)} FROM {view}", doubles, 9)

    @query(name, sql)
    def _(spark, d):
        return rounded(build(spark, d).select(*j.RACE, "driver_code", *columns), 9)


M03 = ["grid_position", "qualifying_advantage", "pole_position_bonus", "front_row_bonus", "top_5_bonus", "avg_quali_position"]
model_query("M03_qualifying_features", M03, " ".join(M03[1:]), "base", lambda p, d: sc.qualifying_features(entries(p, d)))
M04 = ["rain_specialist", "heat_tolerance", "weather_advantage", "weather_risk_factor"]
model_query("M04_weather_features", M04, " ".join(M04), "feat2", lambda p, d: sc.weather_features(entries(p, d), RAIN(), HEAT()))
M05 = ["circuit_type_advantage", "overtaking_advantage", "historical_winner_bonus"]
model_query("M05_circuit_features", M05, " ".join(M05), "feat", features)
M06 = ["expected_quali_position", "expected_race_position", "competitiveness_score"]
model_query("M06_expected_performance", M06, " ".join(M06), "feat3", features)
M07 = ["data_confidence", "historical_avg_position", "historical_consistency", "circuit_experience", "rookie_penalty"]


def proxied(spark, d):
    rows, known = entries(spark, d), b.results(spark, d)
    mates = rows.select("season_year", "circuit_name", F.col("teammate").alias("driver_code"))
    asked = rows.select("season_year", "circuit_name", "driver_code").unionByName(mates)
    past = h.features_before(asked, known, ("circuit_name", "driver_code"))
    return sc.proxy_history(sc.confidence_before(rows, known), past, rookies(spark, d), by=["season_year"])


model_query("M07_proxy_history", M07, " ".join(M07), "feat", proxied)
M08 = [*M07, "current_form_score", "current_team_performance", "recent_momentum", *M03, *M04, *M05, *M06]
model_query("M08_prediction_features", M08, " ".join(c for c in M08 if c != "grid_position"), "feat3", features)
model_query("M09_grid_boost", ["grid_boost"], "grid_boost", "scored", lambda p, d: sc.grid_boost(features(p, d)))
model_query("M10_team_advantage", ["team_advantage"], "team_advantage", "scored", lambda p, d: sc.team_advantage(entries(p, d)))
model_query("M11_main_score", ["main_score"], "main_score", "pats", lambda p, d: sc.main_score(features(p, d)))
model_query("M12_pattern_score", ["pattern_score"], "pattern_score", "predicted WHERE pattern_score IS NOT NULL",
            lambda p, d: sc.pattern_score(features(p, d), b.results(p, d)))
model_query("M13_predict", ["win_probability", "rank", "data_confidence", "championship_position", "is_rookie"], "win_probability data_confidence",
            "ranked", lambda p, d: sc.predict(features(p, d), b.results(p, d)))
model_query("T05_top_predictions", ["win_probability", "rank"], "win_probability", "ranked WHERE rank <= 10",
            lambda p, d: sc.top_predictions(sc.win_probabilities(features(p, d), b.results(p, d))))

JUDGED = """,
judged AS (SELECT r.season_year, r.round_number, r.driver_code AS winner, p.rank AS predicted_rank, coalesce(p.rank <= 1, false) AS winner_predicted,
  coalesce(p.rank <= 3, false) AS top_3, coalesce(p.rank <= 5, false) AS top_5
 FROM (SELECT * FROM results JOIN seasons USING (season_year, series) WHERE finish_position = 1) r LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) p USING (season_year, round_number, driver_code))"""


def actual(spark, d):
    """Winners of the races of all seasons that could be predicted."""
    raced = b.results(spark, d).join(b.seasons(spark, d), ["season_year", "series"], "left_semi")
    return h.races(raced).filter("winner IS NOT NULL")


@query("J12_judged", MODEL_SQL.rstrip() + JUDGED + " SELECT * FROM judged")
def _(spark, d):
    top = sc.top_predictions(sc.win_probabilities(features(spark, d), b.results(spark, d)))
    return j.judged(top, actual(spark, d))


@query("M14_evaluate", rounded_sql(MODEL_SQL.rstrip() + JUDGED, """
 SELECT count(*) AS races, avg(winner_predicted::INT) AS winner_accuracy, avg(top_3::INT) AS top_3_accuracy, avg(top_5::INT) AS top_5_accuracy, avg(predicted_rank) AS mean_predicted_rank FROM judged""",
    "winner_accuracy top_3_accuracy top_5_accuracy mean_predicted_rank"))
def _(spark, d):
    top = sc.top_predictions(sc.win_probabilities(features(spark, d), b.results(spark, d)))
    return rounded(j.evaluate(top, actual(spark, d)))


@query("M15_circuit_advantage", rounded_sql(MODEL_SQL, """
SELECT season_year, round_number, driver_code, least(CASE WHEN special THEN 0.15 ELSE 0 END + CASE WHEN heaty THEN 0.2 ELSE 0 END + historical_winner_bonus, 0.4) AS circuit_advantage FROM feat""", "circuit_advantage"))
def _(spark, d):
    out = sc.circuit_advantage(features(spark, d), SPECIALIST(), HEAT())
    return rounded(out.select(*j.RACE, "driver_code", "circuit_advantage"))


@query("M16_process_standings", rounded_sql(V(s.RESULTS, s.STANDINGS), f"""
SELECT season_year, driver_code, upper(substring(driver_code, 1, 3)) AS code, CASE lower(team) {' '.join(f"WHEN '{a}' THEN '{v}'" for a, v in k.TEAM_NAMES.items())} ELSE team END AS team, position, points,
 greatest(0.1, (21 - position) / 20) AS form_score, CASE WHEN position <= 2 THEN 'top_tier' WHEN position <= 5 THEN 'upper_midfield' WHEN position <= 7 THEN 'midfield' ELSE 'lower_tier' END AS performance_tier
FROM (SELECT season_year, driver_code, {NAME_LIST}[CAST(substring(driver_code, 2) AS BIGINT) % {len(NAMES)} + 1] AS team, position, points FROM standings)""", "form_score"))
def _(spark, d):
    table = b.standings(spark, d).withColumn("driver_number", F.substring("driver_code", 2, 9).cast("long"))
    out = r.process_standings(named_team(table), name="driver_code")
    return rounded(out.select("season_year", "driver_code", "code", "team", "position", "points", "form_score", "performance_tier"))
