"""Queries over marts and the serving layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import cleaning as c
from lapforge.operators import history as h
from lapforge.operators import laps as l
from lapforge.operators import marts as m
from lapforge.plans import bindings as b
from lapforge.plans import bindings_sql as s
from lapforge.plans.registry import query, rounded, rounded_sql

V = s.with_views

PERF = """,
perf AS (
 SELECT driver_code, circuit_name, count(*) AS races_at_circuit, avg(finish_position) AS avg_finish, min(finish_position) AS best_finish,
  avg(grid_position) AS avg_grid, sum(points) AS total_points, count(*) FILTER (finish_position = 1) AS wins,
  count(*) FILTER (finish_position <= 3) AS podiums, count(*) FILTER (finish_position <= 10) AS points_finishes,
  count(*) FILTER (finish_position IS NULL) AS dnfs, avg(grid_position - finish_position) AS avg_positions_gained,
  1 / (1 + coalesce(stddev_samp(finish_position), 0)) AS consistency_score,
  count(*) FILTER (finish_position = 1) / count(*) AS win_rate, count(*) FILTER (finish_position <= 3) / count(*) AS podium_rate,
  count(*) FILTER (finish_position IS NULL) / count(*) AS dnf_rate
 FROM results GROUP BY ALL)"""
PERF_D = "avg_finish avg_grid total_points avg_positions_gained consistency_score win_rate podium_rate dnf_rate"


@query("A02_driver_circuit_performance", rounded_sql(V(s.RESULTS + PERF), "SELECT * FROM perf", PERF_D))
def _(spark, d):
    return rounded(m.driver_circuit_performance(b.results(spark, d)))


WEIGHTED = """,
wr AS (SELECT r.*, pow(0.5, (max(season_year) OVER () - season_year) / 2.0) * coalesce(regulation_similarity_weight, 1) AS w
 FROM results r LEFT JOIN circuit_dim USING (circuit_name))"""


@query("W15_weighted_performance", rounded_sql(V(s.RESULTS, s.CIRCUITS + WEIGHTED), """
SELECT driver_code, circuit_name, count(*) AS races_at_circuit, avg(finish_position) AS avg_finish,
 sum(finish_position * w) / nullif(sum(w) FILTER (finish_position IS NOT NULL), 0) AS weighted_avg_finish,
 sum((grid_position - finish_position) * w) / nullif(sum(w) FILTER (finish_position IS NOT NULL), 0) AS weighted_positions_gained,
 sum(points * w) / nullif(sum(w), 0) AS weighted_points
FROM wr GROUP BY ALL""", "avg_finish weighted_avg_finish weighted_positions_gained weighted_points"))
def _(spark, d):
    mart = m.driver_circuit_performance(b.results(spark, d), b.circuit_dim(spark, d))
    keep = ["driver_code", "circuit_name", "races_at_circuit", "avg_finish", "weighted_avg_finish",
            "weighted_positions_gained", "weighted_points"]
    return rounded(mart.select(*keep))


@query("J06_with_weight", V(s.RESULTS, s.CIRCUITS) + """
SELECT season_year, round_number, driver_code, coalesce(regulation_similarity_weight, 1) AS regulation_similarity_weight,
 regulation_similarity_weight IS NOT NULL AS weight_matched FROM results LEFT JOIN circuit_dim USING (circuit_name)""")
def _(spark, d):
    out = m.with_weight(b.results(spark, d), b.circuit_dim(spark, d))
    return out.select("season_year", "round_number", "driver_code", "regulation_similarity_weight", "weight_matched")


LAST5 = """,
last5 AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY driver_code ORDER BY season_year DESC, round_number DESC) <= 5)"""


@query("W11_last_n", V(s.RESULTS + LAST5) + "SELECT driver_code, season_year, round_number, finish_position FROM last5")
def _(spark, d):
    return m.last_n(b.results(spark, d)).select("driver_code", "season_year", "round_number", "finish_position")


@query("A03_driver_form_last5", rounded_sql(V(s.RESULTS + LAST5), """
SELECT driver_code, count(*) AS races_counted, avg(finish_position) AS avg_finish_last5, min(finish_position) AS best_finish_last5,
 sum(points) AS total_points_last5, stddev_samp(finish_position) AS finish_stddev_last5,
 1 / (1 + coalesce(stddev_samp(finish_position), 0)) AS consistency_score_last5,
 avg(grid_position - finish_position) AS avg_positions_gained_last5,
 count(*) FILTER (finish_position <= 3) AS podiums_last5, count(*) FILTER (finish_position <= 10) AS points_finishes_last5
FROM last5 GROUP BY ALL""", "avg_finish_last5 total_points_last5 finish_stddev_last5 consistency_score_last5 avg_positions_gained_last5"))
def _(spark, d):
    return rounded(m.driver_form_last5(b.results(spark, d)))


TIRE = """,
stints AS (
 SELECT circuit_name, driver_code, compound, count(*) AS n, regr_slope(lap_time_seconds, tyre_life) AS sl,
  sum(lap_time_seconds) AS t, min(lap_time_seconds) AS best
 FROM race_laps WHERE lap_time_seconds IS NOT NULL
 GROUP BY circuit_name, driver_code, compound, season_year, round_number, stint),
tire AS (
 SELECT circuit_name, driver_code, compound, CAST(sum(n) AS BIGINT) AS n_laps,
  sum(CASE WHEN isnan(sl) THEN NULL ELSE sl * n END) / nullif(sum(CASE WHEN isnan(sl) OR sl IS NULL THEN NULL ELSE n END), 0) AS deg_seconds_per_lap,
  sum(t) / sum(n) AS avg_lap_time, min(best) AS fastest_lap
 FROM stints GROUP BY ALL)"""


@query("A04_tire_degradation", rounded_sql(V(s.RACE_LAPS + TIRE), "SELECT * FROM tire", "deg_seconds_per_lap avg_lap_time"))
def _(spark, d):
    out = m.tire_degradation(b.laps(spark, d))
    return out.withColumns({x: F.round(x, 6) + F.lit(0.0) for x in ("deg_seconds_per_lap", "avg_lap_time")})


@query("A04_tire_degradation_pooled", rounded_sql(V(s.RACE_LAPS), """
SELECT circuit_name, driver_code, compound, count(*) AS n_laps,
 CASE WHEN isnan(regr_slope(lap_time_seconds, tyre_life)) THEN NULL ELSE regr_slope(lap_time_seconds, tyre_life) END AS deg_seconds_per_lap,
 avg(lap_time_seconds) AS avg_lap_time, min(lap_time_seconds) AS fastest_lap
FROM race_laps WHERE lap_time_seconds IS NOT NULL GROUP BY circuit_name, driver_code, compound""", "deg_seconds_per_lap avg_lap_time fastest_lap"))
def _(spark, d):
    return rounded(m.tire_degradation(b.laps(spark, d), pooled=True))


@query("A05_compound_degradation", V(s.RACE_LAPS + TIRE) + """
SELECT circuit_name, compound, round(avg(deg_seconds_per_lap), 4) + 0 AS avg_degradation_per_lap, count(DISTINCT driver_code) AS driver_count,
 round(avg(n_laps), 1) AS avg_stint_length FROM tire WHERE n_laps >= 8 GROUP BY ALL""")
def _(spark, d):
    return m.compound_degradation(m.tire_degradation(b.laps(spark, d)))


@query("P14_min_sample", V(s.RACE_LAPS + TIRE) + "SELECT circuit_name, driver_code, compound, n_laps FROM tire WHERE n_laps >= 8")
def _(spark, d):
    mart = c.min_sample(m.tire_degradation(b.laps(spark, d)), "n_laps", m.MIN_STINT_LAPS)
    return mart.select("circuit_name", "driver_code", "compound", "n_laps")


@query("A06_driver_totals", V(s.RESULTS + PERF) + """
SELECT driver_code, CAST(sum(races_at_circuit) AS BIGINT) AS total_races, CAST(sum(wins) AS BIGINT) AS total_wins,
 CAST(sum(podiums) AS BIGINT) AS total_podiums FROM perf WHERE lower(circuit_name) NOT IN ('hungarian', 'monza') GROUP BY 1""")
def _(spark, d):
    return m.driver_totals(m.driver_circuit_performance(b.results(spark, d)))


@query("A07_platform_stats", V(s.RESULTS + PERF) + """
SELECT (SELECT count(DISTINCT circuit_name) FROM perf) AS circuits_ingested, min(season_year) AS first_season, max(season_year) AS last_season,
 count(*) AS total_race_entries, (SELECT count(*) FROM laps) AS total_laps_processed FROM results""")
def _(spark, d):
    results = b.results(spark, d)
    return m.platform_stats(results, b.laps(spark, d), m.driver_circuit_performance(results))


@query("A08_load_check", V(s.LAPS) + """
SELECT coalesce(a.season_year, e.season_year) AS season_year, coalesce(a.round_number, e.round_number) AS round_number,
 loaded_rows, laps, drivers, expected_rows, loaded_rows = expected_rows AS complete
FROM (SELECT season_year, round_number, count(*) AS loaded_rows, count(DISTINCT lap_number) AS laps, count(DISTINCT driver_code) AS drivers FROM laps GROUP BY ALL) a
FULL JOIN (SELECT season_year, round_number, count(*) AS expected_rows FROM raw_laps GROUP BY ALL) e USING (season_year, round_number)""")
def _(spark, d):
    return m.load_check(b.laps(spark, d), b.raw_laps(spark, d), ["season_year", "round_number"])


@query("T01_top_drivers", V(s.RESULTS + PERF) + """
SELECT driver_code, races_at_circuit, round(avg_finish, 6) AS avg_finish, wins, podiums FROM perf
WHERE circuit_name = 'Circuit 1' AND avg_finish IS NOT NULL ORDER BY perf.avg_finish, driver_code LIMIT 5""")
def _(spark, d):
    return rounded(m.top_drivers(m.driver_circuit_performance(b.results(spark, d)), "Circuit 1"))


LONGEST = """,
chosen AS (SELECT season_year, round_number, driver_code, stint, count(*) AS count FROM race_laps
 WHERE circuit_name = 'Circuit 1' AND compound = 'SOFT' AND lap_time_seconds IS NOT NULL GROUP BY ALL
 ORDER BY count(*) DESC, season_year DESC, driver_code, round_number DESC, stint LIMIT 1)"""
STINT_SQL = V(s.RACE_LAPS + LONGEST) + """
SELECT driver_code, lap_number, tyre_life, round(lap_time_seconds, 3) AS lap_time_seconds
FROM race_laps JOIN chosen USING (season_year, round_number, driver_code, stint)
WHERE circuit_name = 'Circuit 1' AND compound = 'SOFT' AND lap_time_seconds IS NOT NULL ORDER BY lap_number"""


@query("J01_longest_stint", STINT_SQL)
def _(spark, d):
    return m.longest_stint(b.laps(spark, d), "Circuit 1", "soft")


@query("T08_stint_sample", STINT_SQL.replace("SELECT driver_code, lap_number", "SELECT driver_code, 'SOFT' AS compound, lap_number"))
def _(spark, d):
    out = m.longest_stint(b.laps(spark, d), "Circuit 1", "SOFT")
    return out.withColumn("compound", F.lit("SOFT")).orderBy("lap_number")


@query("T02_longest_stint_key", V(s.RACE_LAPS + LONGEST) + "SELECT * FROM chosen")
def _(spark, d):
    return m.longest_stint_key(b.laps(spark, d), "Circuit 1", "SOFT")


SEASON = """,
season AS (SELECT season_year, count(DISTINCT lap_number) AS distinct_laps FROM placed_laps WHERE circuit_name = 'Circuit 2' AND session_type = 'RACE'
 GROUP BY 1 HAVING count(DISTINCT lap_number) >= 20 ORDER BY season_year DESC LIMIT 1)"""


@query("T03_latest_full_season", V(s.PLACED_LAPS + SEASON) + "SELECT * FROM season")
def _(spark, d):
    return m.latest_full_season(b.placed_laps(spark, d), "Circuit 2")


@query("T04_race_replay", V(s.PLACED_LAPS + SEASON) + """
SELECT season_year, max(lap_number) OVER () AS total_laps, lap_number, position, driver_code, round(lap_time_seconds, 3) AS lap_time_seconds
FROM placed_laps JOIN season USING (season_year) WHERE circuit_name = 'Circuit 2' AND session_type = 'RACE'""")
def _(spark, d):
    return m.race_replay(b.placed_laps(spark, d), "Circuit 2")


@query("T06_leaderboard", V(s.PLACED_LAPS) + """
SELECT season_year, round_number, session_type, lap_number, driver_code, position AS place FROM placed_laps WHERE position <= 10""")
def _(spark, d):
    out = m.leaderboard(b.placed(b.timed_laps(spark, d)))
    return out.select("season_year", "round_number", "session_type", "lap_number", "driver_code", "place")


@query("T09_degradation_sample", rounded_sql(V(s.RACE_LAPS + TIRE), """
SELECT circuit_name, driver_code, compound, n_laps, deg_seconds_per_lap FROM tire WHERE lower(circuit_name) LIKE '%circuit 3%'
ORDER BY compound, deg_seconds_per_lap DESC NULLS LAST, circuit_name, driver_code LIMIT 15""", "deg_seconds_per_lap"))
def _(spark, d):
    return rounded(m.degradation_sample(m.tire_degradation(b.laps(spark, d)), "circuit 3"))


@query("T10_default_compound", V(s.RACE_LAPS + TIRE) + """
SELECT circuit_name, arg_min(compound, CASE compound WHEN 'MEDIUM' THEN 0 WHEN 'SOFT' THEN 1 WHEN 'HARD' THEN 2 END) AS compound
FROM tire WHERE compound IN ('MEDIUM', 'SOFT', 'HARD') GROUP BY 1""")
def _(spark, d):
    return m.default_compound(m.tire_degradation(b.laps(spark, d)))


@query("W16_scale_to_max", rounded_sql(V(s.RACE_LAPS + TIRE), """
SELECT circuit_name, driver_code, compound, abs(deg_seconds_per_lap) / nullif(max(abs(deg_seconds_per_lap)) OVER (PARTITION BY circuit_name, compound), 0) AS scaled
FROM tire""", "scaled"))
def _(spark, d):
    out = l.scale_to_max(m.tire_degradation(b.laps(spark, d)), ["circuit_name", "compound"], "deg_seconds_per_lap")
    return rounded(out.select("circuit_name", "driver_code", "compound", "scaled"))


@query("W17_inverse_scale", rounded_sql(V(s.RESULTS + PERF), """
SELECT driver_code, circuit_name, greatest(15.0, 100 - (avg_finish - 1) / max(avg_finish) OVER (PARTITION BY driver_code) * 80) AS bar_width
FROM perf WHERE avg_finish IS NOT NULL""", "bar_width"))
def _(spark, d):
    perf = m.driver_circuit_performance(b.results(spark, d)).filter("avg_finish IS NOT NULL")
    out = l.inverse_scale(perf, ["driver_code"], "avg_finish")
    return rounded(out.select("driver_code", "circuit_name", "bar_width"))


@query("W12_normalize", rounded_sql(V(s.RESULTS), """
SELECT season_year, round_number, driver_code, CASE WHEN sum(points) OVER w > 0 THEN points / sum(points) OVER w ELSE points END AS share
FROM results WINDOW w AS (PARTITION BY season_year, round_number)""", "share"))
def _(spark, d):
    out = m.normalize(b.results(spark, d), h.RACE, "points", "share")
    return rounded(out.select(*h.RACE, "driver_code", "share"))


@query("W13_top_margin", V(s.RESULTS) + """
SELECT season_year, round_number, driver_code, points, points - coalesce(nxt, 0) AS margin FROM (
 SELECT *, lead(points) OVER w AS nxt, row_number() OVER w AS rn FROM results
 WINDOW w AS (PARTITION BY season_year, round_number ORDER BY points DESC, driver_code)) WHERE rn = 1""")
def _(spark, d):
    return m.top_margin(b.results(spark, d), h.RACE, "points")
