"""Queries for names, scalar functions, weather and text extraction.

Extraction queries render rows of the results as reports and pages, extract them
again and compare with the flat rows; others read the given texts as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge import constants as k
from lapforge.functions import scalar as fn
from lapforge.operators import cleaning as c
from lapforge.operators import extract as x
from lapforge.operators import reports
from lapforge.operators import resolve as r
from lapforge.operators import weather as w
from lapforge.operators.history import difficulty
from lapforge.plans import bindings as b
from lapforge.plans import bindings_sql as s
from lapforge.plans.registry import query, rounded, rounded_sql
from lapforge.plans.scoring_queries import NAME_LIST, NAMES, named_team
from lapforge.schemas import schema

V = s.with_views
RESULTS = V(s.RESULTS)
PART = "SELECT p_partkey, p_name, "


def part(spark, d):
    return b.table(spark, d, "part")


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


# --- cleaning ---------------------------------------------------------------------------
BAD_SQL = V(s.RESULTS) + """,
bad AS (SELECT season_year, round_number, driver_code, driver_number,
 CASE driver_number % 7 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN points + 0.75 WHEN 3 THEN -points - 0.75 ELSE points END AS points,
 CASE driver_number % 5 WHEN 0 THEN 'NC' WHEN 1 THEN ' ' || finish_position || ' ' WHEN 2 THEN '7.9' WHEN 3 THEN 'DQ' ELSE CAST(finish_position AS VARCHAR) END AS finish_position,
 CASE WHEN finish_position IS NULL THEN 99 ELSE grid_position END AS grid_position,
 CASE driver_number % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 END AS rainfall FROM results) """


def bad_rows(spark, d):
    """Results spoiled the way raw feeds are: NaN, infinity, text in numbers, marker 99."""
    res, n = b.results(spark, d), F.col("driver_number")
    points, fin = F.col("points"), F.col("finish_position").cast("string")
    return res.select(
        "season_year", "round_number", "driver_code", "driver_number",
        F.when(n % 7 == 0, float("nan")).when(n % 7 == 1, float("inf")).when(n % 7 == 2, points + 0.75)
        .when(n % 7 == 3, -points - 0.75).otherwise(points).alias("points"),
        F.when(n % 5 == 0, "NC").when(n % 5 == 1, F.concat(F.lit(" "), fin, F.lit(" "))).when(n % 5 == 2, "7.9")
        .when(n % 5 == 3, "DQ").otherwise(fin).alias("finish_position"),
        F.when(F.col("finish_position").isNull(), 99).otherwise(F.col("grid_position")).alias("grid_position"),
        F.when(n % 3 == 0, 0.0).when(n % 3 == 1, 1.0).alias("rainfall"),
    )


@query("P01_sanitize", BAD_SQL + """
SELECT season_year, round_number, driver_code, CASE WHEN isnan(points) OR isinf(points) THEN NULL ELSE points END AS points,
 CASE WHEN isnan(points) OR isinf(points) THEN NULL ELSE CAST(trunc(points) AS INTEGER) END AS whole_points,
 CASE WHEN regexp_full_match(trim(finish_position), '[+-]?[0-9]+') THEN CAST(trim(finish_position) AS INTEGER) END AS finish_position,
 rainfall <> 0 AS rainfall FROM bad""")
def _(spark, d):
    rows = bad_rows(spark, d).withColumn("whole_points", F.col("points"))
    fixed = c.sanitize(rows, schema("points:double whole_points:int finish_position:int rainfall:boolean"))
    return fixed.select("season_year", "round_number", "driver_code", "points", "whole_points", "finish_position", "rainfall")


@query("P02_stamp", RESULTS + """SELECT season_year, round_number, driver_code, coalesce(CASE WHEN status = 'Finished' THEN 'batch' END, 'now') AS ingested_at FROM results""")
def _(spark, d):
    rows = b.results(spark, d).withColumn("ingested_at", F.when(F.col("status") == "Finished", "batch"))
    return c.stamp(rows, at=F.lit("now")).select("season_year", "round_number", "driver_code", "ingested_at")


@query("P12_null_sentinels", BAD_SQL + "SELECT season_year, round_number, driver_code, nullif(grid_position, 99) AS grid_position FROM bad")
def _(spark, d):
    return c.null_sentinels(bad_rows(spark, d), ["grid_position"]).select("season_year", "round_number", "driver_code", "grid_position")


@query("P13_numeric_positions", BAD_SQL + """
SELECT season_year, round_number, driver_code, CAST(trim(finish_position) AS INTEGER) AS finish_position FROM bad WHERE regexp_full_match(trim(finish_position), '[+-]?[0-9]+')""")
def _(spark, d):
    return c.numeric_positions(bad_rows(spark, d), "finish_position").select("season_year", "round_number", "driver_code", "finish_position")


@query("P09_exclude_aliases", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) NOT IN ('small ring', 'red widget')")
def _(spark, d):
    return c.exclude_aliases(part(spark, d), "p_name", ["Small Ring", "red widget"]).select("p_partkey", "p_name")


@query("P10_where_like", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%gizmo%'")
def _(spark, d):
    return c.where_like(part(spark, d), "p_name", "Gizmo").select("p_partkey", "p_name")


@query("P15_valid_coordinates", V(s.CIRCUITS) + """
SELECT circuit_key, len(coordinates) = 2 AND coordinates[1] BETWEEN -90 AND 90 AND coordinates[2] BETWEEN -180 AND 180 AS coordinates_valid FROM circuit_dim""")
def _(spark, d):
    return c.valid_coordinates(b.circuit_dim(spark, d)).select("circuit_key", "coordinates_valid")


ALIASES = {"small ring": "Little Ring", "red widget": "Crimson Widget"}


@query("U01_distinct_names", "SELECT DISTINCT CASE lower(p_name) WHEN 'small ring' THEN 'Little Ring' WHEN 'red widget' THEN 'Crimson Widget' ELSE p_name END AS p_name FROM part")
def _(spark, d):
    return c.distinct_names(part(spark, d), "p_name", ALIASES)


@query("F07_canonical", PART + "CASE lower(p_name) WHEN 'small ring' THEN 'Little Ring' WHEN 'red widget' THEN 'Crimson Widget' ELSE p_name END AS canonical FROM part")
def _(spark, d):
    return part(spark, d).select("p_partkey", "p_name", c.canonical("p_name", ALIASES).alias("canonical"))


# --- names ------------------------------------------------------------------------------
# The alias dimension: the second word of every distinct part name is a key, known by
# that word, by the word without its first letter and by all names that end in it.
DIM_SQL = """WITH words AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS key FROM part WHERE p_name NOT LIKE '%widget'),
aliases AS (SELECT DISTINCT key, unnest(list_distinct([key, replace(key, ' ', ''), key || ' grand prix', key || ' gp', substring(key, 2), substring(key, 2) || ' grand prix', substring(key, 2) || ' gp'])) AS alias FROM words)
"""


def aliases(spark, d):
    words = part(spark, d).filter("p_name NOT LIKE '%widget'").select(F.element_at(F.split("p_name", " "), 2).alias("key")).distinct()
    names = F.array("key", F.substr("key", F.lit(2)))
    return r.alias_table(words.withColumn("names", names), "key", "names")


@query("J07_resolve_names", DIM_SQL + """, names AS (SELECT DISTINCT lower(trim(n_or_p)) AS name FROM (SELECT p_name AS n_or_p FROM part UNION ALL SELECT p_type FROM part)),
best AS (SELECT name, key FROM names JOIN aliases ON contains(name, alias) OR contains(alias, name)
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY (name <> alias)::INT, length(alias) DESC, key) = 1)
SELECT p_partkey, p_name, key AS resolved_key FROM part LEFT JOIN best ON lower(trim(p_name)) = name""")
def _(spark, d):
    return r.resolve_names(part(spark, d), "p_name", aliases(spark, d), "key").select("p_partkey", "p_name", "resolved_key")


@query("J08_suggest_names", DIM_SQL + """, names AS (SELECT DISTINCT lower(p_name) AS name FROM part),
hits AS (SELECT DISTINCT name, 'The ' || key AS suggestion FROM names, aliases
 WHERE list_bool_or([contains(alias, q) FOR q IN string_split(name, ' ')]) OR list_bool_or([contains(name, q) FOR q IN string_split(alias, ' ')]))
SELECT name, suggestion, CAST(row_number() OVER (PARTITION BY name ORDER BY suggestion) AS INTEGER) AS place FROM hits QUALIFY place <= 5""")
def _(spark, d):
    dim = aliases(spark, d).withColumn("title", F.concat(F.lit("The "), "key"))
    return r.suggest_names(part(spark, d), "p_name", dim, "title")


@query("T07_list_circuits", "SELECT p_name AS name FROM part")
def _(spark, d):
    return r.list_circuits(part(spark, d).select(F.array("p_name", "p_type").alias("official_names")))


LETTERS = "chr(CAST(65 + ({0} // 676) % 26 AS INTEGER)) || chr(CAST(65 + ({0} // 26) % 26 AS INTEGER)) || chr(CAST(65 + {0} % 26 AS INTEGER))"


@query("F04_driver_code", f"""
SELECT s_suppkey, name, CASE WHEN regexp_full_match(upper(trim(name)), '[A-Z]{{3}}') THEN upper(trim(name)) WHEN lower(trim(name)) = 'max verstappen' THEN 'VER'
 ELSE rpad(upper(substring(list_extract(string_split(trim(name), ' '), -1), 1, 3)), 3, 'X') END AS code FROM (
 SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lower({LETTERS.format('s_suppkey')}) WHEN 1 THEN s_name WHEN 2 THEN ' Max Verstappen' ELSE 'Ann Li' END AS name FROM supplier)""")
def _(spark, d):
    n = F.col("s_suppkey")
    name = F.when(n % 4 == 0, F.lower(b.letters(n))).when(n % 4 == 1, F.col("s_name")).when(n % 4 == 2, " Max Verstappen").otherwise("Ann Li")
    rows = b.table(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    return rows.withColumn("code", r.driver_code(F.col("name")))


TEAM_CASE = " ".join(f"WHEN {quoted(a)} THEN {quoted(v)}" for a, v in k.TEAM_NAMES.items())


@query("F05_team_name", f"""
SELECT s_suppkey, raw, CASE lower(trim(raw)) {TEAM_CASE} ELSE array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS team,
 CASE {" ".join(f"WHEN contains(lower(raw), {quoted(a)}) THEN {quoted(v)}" for a, v in k.TEAM_WORDS.items())}
  ELSE array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS team_in_text
FROM (SELECT s_suppkey, lower({NAME_LIST}[s_suppkey % {len(NAMES)} + 1]) AS raw FROM supplier)""")
def _(spark, d):
    rows = named_team(b.table(spark, d, "supplier"), "s_suppkey").withColumn("raw", F.lower("team"))
    return rows.select("s_suppkey", "raw", r.team_name(F.col("raw")).alias("team"), r.team_in_text(F.col("raw")).alias("team_in_text"))


@query("F06_clean_name", PART + "upper(substring(p_name, 1, 1)) || substring(string_split(p_name, ' ')[1], 2) || ' ' || upper(substring(string_split(p_name, ' ')[2], 1, 1)) || substring(string_split(p_name, ' ')[2], 2) AS cleaned FROM part")
def _(spark, d):
    raw = F.concat(F.lit("P"), (F.col("p_size") % 20).cast("string"), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("   ")))
    return part(spark, d).select("p_partkey", "p_name", r.clean_name(raw).alias("cleaned"))


@query("F08_standard_gp_name", f"""
SELECT p_partkey, raw, CASE {" ".join(f"WHEN contains(lower(raw), {quoted(a)}) THEN {quoted(v)}" for a, v in k.GP_WORDS.items())}
 WHEN contains(lower(raw), 'grand prix') THEN replace(raw, 'Grand Prix', 'GP') ELSE raw || ' Grand Prix' END AS gp
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' Monza' WHEN 1 THEN 'the spa ' || p_name WHEN 2 THEN p_name || ' Grand Prix' WHEN 3 THEN 'Abu Dhabi ' || p_brand ELSE p_name END AS raw FROM part)""")
def _(spark, d):
    n, name = F.col("p_partkey"), F.col("p_name")
    raw = (F.when(n % 5 == 0, F.concat(name, F.lit(" Monza"))).when(n % 5 == 1, F.concat(F.lit("the spa "), name))
           .when(n % 5 == 2, F.concat(name, F.lit(" Grand Prix"))).when(n % 5 == 3, F.concat(F.lit("Abu Dhabi "), "p_brand")).otherwise(name))
    rows = part(spark, d).select("p_partkey", raw.alias("raw"))
    return rows.withColumn("gp", r.standard_gp_name(F.col("raw")))


@query("F08_names_index", f"""
SELECT p_partkey, raw, CASE {" ".join(f"WHEN contains(lower(raw), {quoted(a)}) THEN {quoted(v)}" for a, v in k.GP_WORDS.items())} END AS gp
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' at MONZA, ' || p_brand WHEN 1 THEN 'the spa ' || p_name || ' or Hungarian' ELSE p_name END AS raw FROM part)""")
def _(spark, d):
    """The first known name inside each text, through an index of the names instead of one search for each."""
    n, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(n % 3 == 0, F.concat(name, F.lit(" at MONZA, "), "p_brand")).when(n % 3 == 1, F.concat(F.lit("the spa "), name, F.lit(" or Hungarian"))).otherwise(name)
    known = spark.createDataFrame([(a, v, i) for i, (a, v) in enumerate(k.GP_WORDS.items())], "known string, full string, rank int")
    return r.first_names(part(spark, d).select("p_partkey", raw.alias("raw")), "p_partkey", "raw", known, "gp")


# --- scalar functions -------------------------------------------------------------------
KEY = "season_year, round_number, session_type, driver_code, lap_number"
MILLIS = "CAST(round(lap_time_seconds * 1000) AS BIGINT)"
TEXT_TIME = f"printf('%d:%02d.%03d', {MILLIS} // 60000, ({MILLIS} % 60000) // 1000, {MILLIS} % 1000)"


@query("F01_duration_seconds", V(s.TIMED_LAPS) + f"SELECT {KEY}, CAST(round(CAST(lap_time_seconds AS DECIMAL(18,6)), 3) AS DOUBLE) AS seconds FROM timed_laps")
def _(spark, d):
    laps = b.timed_laps(spark, d)
    span = F.make_dt_interval(secs=F.col("lap_time_seconds").cast("decimal(18,6)"))
    return laps.select(*b.LAP_KEY, fn.duration_seconds(span).alias("seconds"))


@query("F02_format_lap_time", V(s.TIMED_LAPS) + f"SELECT {KEY}, {TEXT_TIME} AS lap_time FROM timed_laps")
def _(spark, d):
    return b.timed_laps(spark, d).select(*b.LAP_KEY, fn.format_lap_time(F.col("lap_time_seconds")).alias("lap_time"))


@query("F03_parse_lap_time", V(s.LAPS) + f"SELECT {KEY}, CASE WHEN compound <> 'SOFT' THEN round(lap_time_seconds, 3) END AS seconds FROM laps")
def _(spark, d):
    text = F.when(F.col("compound") == "SOFT", "no time").otherwise(fn.format_lap_time(F.col("lap_time_seconds")))
    return b.laps(spark, d).select(*b.LAP_KEY, F.round(fn.parse_lap_time(text), 3).alias("seconds"))


@query("F09_difficulty", V(s.CIRCUITS) + """
SELECT circuit_key, CASE overtaking_difficulty WHEN 'very_low' THEN 0.2 WHEN 'low' THEN 0.4 WHEN 'high' THEN 0.8 WHEN 'very_high' THEN 1.0 ELSE 0.6 END::DOUBLE AS rating FROM circuit_dim""")
def _(spark, d):
    return b.circuit_dim(spark, d).select("circuit_key", difficulty(F.col("overtaking_difficulty")).alias("rating"))


FACTORS = "overtaking_rating physical_demands technical_complexity strategy_importance driver_skill_factor car_setup_sensitivity"


@query("F10_circuit_factors", rounded_sql(V(s.CIRCUITS), """
SELECT circuit_key, dr AS overtaking_rating, 0.4 AS physical_demands, CASE ct WHEN 'technical' THEN 0.9 WHEN 'street_circuit' THEN 0.8 WHEN 'mixed' THEN 0.6 WHEN 'high_speed' THEN 0.4 ELSE 0.6 END AS technical_complexity,
 (dr + ws) / 2 AS strategy_importance, (CASE ct WHEN 'street_circuit' THEN 0.9 WHEN 'technical' THEN 0.8 WHEN 'mixed' THEN 0.6 WHEN 'high_speed' THEN 0.5 ELSE 0.6 END + dr) / 2 AS driver_skill_factor,
 least(CASE WHEN ct = 'technical' THEN 0.7 ELSE 0.5 END + least((nickname LIKE '%ring')::INT * 0.1, 0.3), 1) AS car_setup_sensitivity
FROM (SELECT *, coalesce(circuit_type, 'mixed') AS ct, coalesce(weather_sensitivity, 0.5) AS ws,
 CASE overtaking_difficulty WHEN 'very_low' THEN 0.2 WHEN 'low' THEN 0.4 WHEN 'high' THEN 0.8 WHEN 'very_high' THEN 1.0 ELSE 0.6 END AS dr FROM circuit_dim)""", FACTORS))
def _(spark, d):
    # Parts called ring get a setup factor.
    named = F.transform("key_factors", lambda f: F.when(f == "ring", "suspension").otherwise(f))
    dim = b.circuit_dim(spark, d).withColumn("key_factors", named)
    return rounded(w.circuit_factors(dim).select("circuit_key", *FACTORS.split()))


@query("F11_tier", RESULTS + """SELECT season_year, round_number, driver_code, CASE WHEN finish_position <= 2 THEN 'top_tier' WHEN finish_position <= 5 THEN 'upper_midfield' WHEN finish_position <= 7 THEN 'midfield' ELSE 'lower_tier' END AS tier FROM results""")
def _(spark, d):
    return b.results(spark, d).select("season_year", "round_number", "driver_code", fn.tier(F.col("finish_position")).alias("tier"))


@query("F12_ordinal_percent", RESULTS + """
SELECT season_year, round_number, driver_code, finish_position || CASE WHEN finish_position % 100 BETWEEN 11 AND 13 THEN 'th' WHEN finish_position % 10 = 1 THEN 'st' WHEN finish_position % 10 = 2 THEN 'nd' WHEN finish_position % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
 printf('%.1f%%', round(points / 101.0 * 100, 1)) AS share FROM results WHERE finish_position IS NOT NULL""")
def _(spark, d):
    done = b.results(spark, d).filter("finish_position IS NOT NULL")
    return done.select("season_year", "round_number", "driver_code", fn.ordinal(F.col("finish_position")).alias("place"), fn.percent(F.col("points") / 101.0).alias("share"))


@query("F16_round_output", V(s.TIMED_LAPS) + f"SELECT {KEY}, round(lap_time_seconds, 1) AS r1, round(lap_time_seconds, 2) AS r2, round(lap_time_seconds, 3) AS r3, round(lap_time_seconds, 4) AS r4 FROM timed_laps")
def _(spark, d):
    t = F.col("lap_time_seconds")
    return b.timed_laps(spark, d).select(*b.LAP_KEY, *[fn.round_output(t, i).alias(f"r{i}") for i in (1, 2, 3, 4)])


@query("F17_rain_probability", V(s.SAMPLES) + "SELECT circuit_name, ts::VARCHAR AS ts, condition, round(coalesce(pop, 0) * 100, 6) AS rain FROM weather_samples")
def _(spark, d):
    ev = b.weather_samples(spark, d)
    stamp = F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return ev.select("circuit_name", stamp.alias("ts"), "condition", F.round(fn.rain_probability(F.col("pop")), 6).alias("rain"))


# --- weather ----------------------------------------------------------------------------
DAILY = """,
daily AS (SELECT circuit_name, CAST(ts AS DATE) AS date, min(temperature) AS temp_min, max(temperature) AS temp_max, avg(temperature) AS temp_avg, avg(humidity) AS humidity_avg,
  avg(wind_speed) AS wind_speed_avg, max(coalesce(pop, 0) * 100) AS rain_probability_max, sum(coalesce(rain_volume, 0)) AS rain_volume_total
 FROM weather_samples GROUP BY ALL),
usual AS (SELECT circuit_name, CAST(ts AS DATE) AS date, condition FROM weather_samples GROUP BY circuit_name, CAST(ts AS DATE), condition
 QUALIFY row_number() OVER (PARTITION BY circuit_name, CAST(ts AS DATE) ORDER BY count(*) DESC, condition) = 1),
days AS (SELECT d.*, u.condition AS dominant_condition FROM daily d JOIN usual u USING (circuit_name, date))"""
DAILY_D = "temp_min temp_max temp_avg humidity_avg wind_speed_avg rain_probability_max rain_volume_total"


def daily(spark, d):
    return w.daily_forecast(b.weather_samples(spark, d))


@query("A34_daily_forecast", rounded_sql(V(s.SAMPLES + DAILY), "SELECT * REPLACE (date::VARCHAR AS date) FROM days", DAILY_D))
def _(spark, d):
    return rounded(daily(spark, d).withColumn("date", F.col("date").cast("string")))


WEEKEND_D = "practice_temperature practice_rain_probability qualifying_temperature qualifying_rain_probability race_temperature race_temp_min race_temp_max race_rain_probability race_wind_speed"


@query("W19_weekend_days", rounded_sql(V(s.SAMPLES + DAILY), """
SELECT circuit_name, max(temp_avg) FILTER (n = 1) AS practice_temperature, max(rain_probability_max) FILTER (n = 1) AS practice_rain_probability,
 max(temp_avg) FILTER (n = 2) AS qualifying_temperature, max(rain_probability_max) FILTER (n = 2) AS qualifying_rain_probability,
 max(temp_avg) FILTER (n = 3) AS race_temperature, max(temp_min) FILTER (n = 3) AS race_temp_min, max(temp_max) FILTER (n = 3) AS race_temp_max,
 max(rain_probability_max) FILTER (n = 3) AS race_rain_probability, max(wind_speed_avg) FILTER (n = 3) AS race_wind_speed, max(dominant_condition) FILTER (n = 3) AS race_conditions
FROM (SELECT *, row_number() OVER (PARTITION BY circuit_name ORDER BY date) AS n FROM days) GROUP BY 1 HAVING count(*) >= 3""", WEEKEND_D))
def _(spark, d):
    return rounded(w.weekend_days(daily(spark, d)))


CLASSES = """temperature AS t, coalesce(pop, 0) * 100 AS rain FROM weather_samples"""


@query("F13_weather_impact_class", V(s.SAMPLES) + f"""
SELECT circuit_name, cls, count(*) AS n FROM (SELECT circuit_name, CASE WHEN rain > 60 THEN 'high_rain_impact' WHEN rain > 30 THEN 'medium_rain_risk' WHEN t > 35 THEN 'extreme_heat'
 WHEN t > 30 AND coalesce(sens, 0.5) > 0.6 THEN 'high_heat_impact' WHEN t < 15 THEN 'cold_conditions' ELSE 'normal_conditions' END AS cls
 FROM (SELECT circuit_name, CASE WHEN circuit_name < 'Circuit 3' THEN 0.8 END AS sens, {CLASSES})) GROUP BY ALL""")
def _(spark, d):
    ev = b.weather_samples(spark, d)
    sensitivity = F.when(F.col("circuit_name") < "Circuit 3", 0.8)
    cls = w.weather_impact_class(F.col("temperature"), fn.rain_probability(F.col("pop")), sensitivity)
    return ev.groupBy("circuit_name", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def sql_notes(*cases):
    whens = " ".join(f"WHEN {cond} THEN [{', '.join(quoted(n) for n in notes)}]" for cond, notes in cases)
    return f"CASE {whens} ELSE [] END"


@query("F14_strategy_notes", V(s.SAMPLES) + f"""
SELECT notes, advantage, count(*) AS n FROM (SELECT array_to_string({sql_notes(('rain > 50', k.NOTES_WET), ('rain > 20', k.NOTES_DAMP))} || {sql_notes(('t > 30', k.NOTES_HOT), ('t < 15', k.NOTES_COLD))}, '; ') AS notes,
 array_to_string({sql_notes(('rain > 40', k.ADVANTAGE_WET))} || {sql_notes(('t > 30', k.ADVANTAGE_HOT))}, '; ') AS advantage FROM (SELECT {CLASSES})) GROUP BY ALL""")
def _(spark, d):
    t, rain = F.col("temperature"), fn.rain_probability(F.col("pop"))
    rows = b.weather_samples(spark, d).select(
        F.array_join(w.strategy_notes(t, rain), "; ").alias("notes"), F.array_join(w.advantage_notes(t, rain), "; ").alias("advantage"))
    return rows.groupBy("notes", "advantage").agg(F.count(F.lit(1)).alias("n"))


@query("F15_fallback_climate", rounded_sql(V(s.CIRCUITS), """
SELECT circuit_key, list_sum(coalesce(temperature_range, [20, 25])) / 2 AS typical_temperature, coalesce(rain_probability, 0.3) * 100 AS typical_rain_probability FROM circuit_dim""", "typical_temperature typical_rain_probability"))
def _(spark, d):
    return rounded(w.fallback_climate(b.circuit_dim(spark, d)).select("circuit_key", "typical_temperature", "typical_rain_probability"))


# --- rendered texts ---------------------------------------------------------------------
TEXTED = f""",
texted AS (SELECT *, season_year || '-' || round_number AS doc_id, {LETTERS.format('driver_number')} AS code, {NAME_LIST}[driver_number % {len(NAMES)} + 1] AS tname,
  CAST(points AS INTEGER) AS pts, '1:15.' || lpad(CAST(finish_position * 7 % 1000 AS VARCHAR), 3, '0') AS laptime
 FROM results WHERE finish_position IS NOT NULL),
named AS (SELECT *, 'Ann ' || substring(code, 1, 1) || lower(substring(code, 2)) AS name FROM texted)"""
NAMED = V(s.RESULTS + TEXTED)
STANDARD = "CASE " + " ".join(f"WHEN contains(lower(tname), {quoted(a)}) THEN {quoted(v)}" for a, v in k.TEAM_WORDS.items())
HINTED = "regexp_matches(lower(tname), 'red bull|ferrari|mercedes|mclaren|aston|alpine')"


def texted(spark, d):
    rows = named_team(b.results(spark, d).filter("finish_position IS NOT NULL"))
    code = b.letters(F.col("driver_number"))
    return rows.select(
        F.concat_ws("-", "season_year", "round_number").alias("doc_id"), "season_year", "round_number", "finish_position", "driver_number", "team",
        code.alias("code"),
        F.concat(F.lit("Ann "), F.initcap(code)).alias("name"),
        F.col("points").cast("int").cast("string").alias("pts"),
        F.concat(F.lit("1:15."), F.lpad((F.col("finish_position") * 7 % 1000).cast("string"), 3, "0")).alias("laptime"),
    )


def documents_of(rows, line, head="", tail=""):
    """One document per race from one line per driver; a race has at most a hundred."""
    place = F.col("finish_position")
    sorted_lines = F.array_sort(F.collect_list(F.struct(place.alias("p"), line.alias("l"))))
    body = F.concat_ws("\n", F.transform(sorted_lines, lambda s_: s_["l"]))
    docs = rows.groupBy("doc_id", "round_number").agg(body.alias("body"))
    return docs.select("doc_id", "round_number", F.concat(F.lit(head), "body", F.lit(tail)).alias("text"))


def place(rows):
    return F.col("finish_position").cast("string")


@query("X05_driver_standings", NAMED + f"""
SELECT doc_id, count(*) OVER (PARTITION BY doc_id) >= 10 AS complete, finish_position AS position, name, code, pts AS points, CASE WHEN {HINTED} THEN {STANDARD} END ELSE 'Unknown' END AS team FROM named""")
def _(spark, d):
    rows = texted(spark, d)
    line = F.concat(place(rows), F.lit(". "), "name", F.lit(" ("), "code", F.lit(") - "), "team", F.lit(" - "), "pts", F.lit(" points"))
    return x.driver_standings(documents_of(rows, line, "Championship table\n", "\nend"))


@query("X06_valid_positions", NAMED + "SELECT doc_id, finish_position AS position, name, pts AS points FROM named")
def _(spark, d):
    rows = texted(spark, d)
    line = F.concat(F.lit("P"), place(rows), F.lit(": "), "name", F.lit(" ("), "team", F.lit(") - "), "pts", F.lit(" pts"))
    return x.driver_standings(documents_of(rows, line, "Championship table\n")).select("doc_id", "position", "name", "points")


@query("X05_team_standings", NAMED + f"SELECT doc_id, finish_position AS position, {STANDARD} ELSE tname END AS team, pts AS points FROM named")
def _(spark, d):
    rows = texted(spark, d)
    line = F.concat(place(rows), F.lit(". "), "team", F.lit(" - "), "pts", F.lit(" points"))
    return x.team_standings(documents_of(rows, line, "Constructors after the race\n"))


def weekend(spark, d):
    """Reports in four layouts, by round: a list with a team in each row of which every third has no time,
    a starting grid by places, a list without heading, and no list at all; practice in as many forms."""
    rows, n = texted(spark, d), F.col("round_number") % 4
    dot = F.concat(place(rows), F.lit(". "), "name")
    timed = F.when(F.col("finish_position") % 3 == 2, F.lit("")).otherwise(F.concat(F.lit(" – "), "laptime"))
    line = (
        F.when(n == 0, F.concat(dot, F.lit(" ("), "team", F.lit(")"), timed))
        .when(n == 1, F.concat(F.lit("P"), place(rows), F.lit(": "), "name", F.lit(" - "), "laptime"))
        .when(n == 2, F.concat(dot, F.when(F.col("finish_position") == 1, F.lit(" (McLaren)")).otherwise(F.lit(" (Other)")), F.lit(" - "), "laptime"))
    )
    lists = documents_of(rows, line)
    first = rows.filter("finish_position = 1").select("doc_id", F.col("name").alias("__name"), F.col("laptime").alias("__time"))
    last = rows.groupBy("doc_id").agg(F.max(F.struct("finish_position", "name"))["name"].alias("__last"))
    docs = lists.join(first, "doc_id").join(last, "doc_id")
    head = F.when(n == 0, F.lit("Qualifying Results:\n")).when(n == 1, F.lit("Starting grid:\n")).otherwise(F.lit("The session was held.\n"))
    practice = (
        F.when(n == 0, F.concat(F.lit("1. FP1 Results\n1. "), "__name", F.lit(" - "), "__time", F.lit("\n2. "), "__last"))
        .when(n == 1, F.concat(F.lit("FP2: "), "__last", F.lit(" fastest ("), "__time", F.lit(")")))
        .when(n == 2, F.concat(F.lit("Practice 3: "), "__last", F.lit(" tops with "), "__time"))
        .otherwise(F.concat(F.lit("Session FP1: "), "__last", F.lit(" "), "__time"))
    )
    said = F.array(*[F.lit(x) for x in PENALTIES])
    incidents = F.element_at(said, (n + 1).cast("int"))
    return docs.withColumn("text", F.concat(
        head, "text", F.lit("\n\n"), "__name", F.lit(" secured pole position with a time of "), "__time", F.lit(".\n\n"), practice,
        F.lit("\n\nThe weather conditions were dry and warm.\n"), F.replace(F.replace(incidents, F.lit("{a}"), F.col("__name")), F.lit("{b}"), F.col("__last")),
        F.lit("\nThe race has finished. Race winner: "), "__name", F.lit(".\nAfter "), F.col("round_number").cast("string"), F.lit(" rounds"),
    )).select("doc_id", "text")


# What a report says about incidents, by round: one, the same twice, two, and several of another kind.
PENALTIES = [
    "A penalty for {a}.",
    "A penalty for {b}.\nThe stewards confirmed the penalty for {b}.",
    "A penalty for {a}.\nA warning to {b}.",
    "An incident involving {b}.\nA penalty to {a}.\nAn investigation involving {b}.",
]
REPORTS = NAMED.rstrip() + """,
pole AS (SELECT doc_id, name, laptime, round_number % 4 AS n FROM named WHERE finish_position = 1),
final AS (SELECT doc_id, arg_max(name, finish_position) AS last FROM named GROUP BY 1),
said AS (SELECT p.*, last, 75000 + CAST(substring(p.laptime, 6) AS BIGINT) AS ms FROM pole p JOIN final USING (doc_id)) """


@query("X07_extract_sections", REPORTS + """,
listed AS (
 SELECT r.doc_id, 'Qualifying' AS session, finish_position AS position, r.name AS driver, n = 0 AND finish_position % 3 = 2 AS estimated, r.laptime, ms + (finish_position - 1) * 100 AS guess
 FROM named r JOIN said USING (doc_id) WHERE n < 3 OR finish_position = 1)
SELECT doc_id, session, position, driver, CASE WHEN estimated THEN printf('%d:%02d.%03d', guess // 60000, (guess % 60000) // 1000, guess % 1000) ELSE laptime END AS time, estimated FROM listed
UNION ALL SELECT doc_id, ['FP1', 'FP2', 'FP3', 'FP1'][n + 1], 1, CASE WHEN n = 0 THEN name ELSE last END, laptime, false FROM said
UNION ALL SELECT doc_id, 'FP1', 2, last, '', false FROM said WHERE n = 0""")
def _(spark, d):
    return reports.weekend_sessions(weekend(spark, d))


@query("X08_extract_pole", NAMED + "SELECT doc_id, name AS pole_driver, laptime AS pole_time FROM named WHERE finish_position = 1")
def _(spark, d):
    return x.extract_pole(weekend(spark, d))


@query("X08_short_pole", NAMED + "SELECT doc_id, name AS pole_driver, laptime AS pole_time FROM named WHERE finish_position = 1")
def _(spark, d):
    """The pole in one line, in three wordings by round."""
    first, n = texted(spark, d).filter("finish_position = 1"), F.col("round_number") % 3
    line = (
        F.when(n == 0, F.concat("name", F.lit(" took pole position with "), "laptime"))
        .when(n == 1, F.concat(F.lit("pole position: "), "name", F.lit(", "), "laptime"))
        .otherwise(F.concat(F.lit("Result\n1. "), "name", F.lit(" in "), "laptime"))
    )
    return x.short_pole(first.select("doc_id", line.alias("text")))


@query("X09_impute_times", NAMED + """
SELECT n.doc_id, n.finish_position AS position, CASE WHEN n.finish_position % 2 = 1 THEN n.laptime ELSE
 printf('%d:%02d.%03d', ms // 60000, (ms % 60000) // 1000, ms % 1000) END AS time
FROM (SELECT n.*, 75000 + CAST(substring(p.laptime, 6) AS BIGINT) + (n.finish_position - 1) * 100 AS ms FROM named n JOIN named p ON n.doc_id = p.doc_id AND p.finish_position = 1) n""")
def _(spark, d):
    rows = texted(spark, d).withColumn("position", F.col("finish_position"))
    pole = rows.filter("position = 1").select("doc_id", F.col("laptime").alias("pole_time"))
    holes = rows.join(pole, "doc_id").withColumn("time", F.when(F.col("position") % 2 == 1, F.col("laptime")).otherwise(""))
    return x.impute_times(holes).select("doc_id", "position", "time")


MENTIONED = REPORTS + """,
mentions AS (
 SELECT doc_id, unnest(CASE n WHEN 0 THEN [name] WHEN 1 THEN [last] WHEN 2 THEN [name, last] ELSE [name, last] END) AS mention FROM said)
"""


@query("X10_incidents", MENTIONED + "SELECT DISTINCT * FROM mentions")
def _(spark, d):
    return x.incidents(weekend(spark, d))


@query("U03_distinct_mentions", MENTIONED + "SELECT doc_id, count(DISTINCT mention) AS mentions FROM mentions GROUP BY doc_id")
def _(spark, d):
    twice = weekend(spark, d).withColumn("text", F.concat_ws("\n", "text", "text"))
    return x.incidents(twice).groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions"))


@query("X10_race_reports", NAMED + "SELECT doc_id, 'were dry and warm' AS weather, name AS winner FROM named WHERE finish_position = 1")
def _(spark, d):
    return x.race_reports(weekend(spark, d))


PHRASES = ["{c} is driving well.", "{c} showing strong form.", "a day of poor form for {c}", "{c} struggling today", "{c} excels at this circuit", "{c} joins the team"]


@query("X11_form_mentions", NAMED + """
SELECT doc_id, driver_number, code, CASE finish_position % 6 WHEN 0 THEN 'in_form' WHEN 1 THEN 'in_form' WHEN 2 THEN 'struggling' WHEN 3 THEN 'struggling' WHEN 4 THEN 'specialist' END AS kind
FROM named WHERE finish_position % 6 < 5 AND finish_position % 6 <> 2
UNION ALL SELECT doc_id, driver_number, 'FOR', 'struggling' FROM named WHERE finish_position % 6 = 2""")
def _(spark, d):
    return x.form_mentions(notes(spark, d), "note_id").select(
        F.element_at(F.split("note_id", "/"), 1).alias("doc_id"), F.element_at(F.split("note_id", "/"), 2).cast("long").alias("driver_number"), "code", "kind")


def notes(spark, d):
    """A short note per driver and race."""
    rows = texted(spark, d)
    texts = F.array(*[F.replace(F.lit(p), F.lit("{c}"), F.lower("code")) for p in PHRASES])
    return rows.select(
        F.concat_ws("/", "doc_id", "driver_number").alias("note_id"),
        F.element_at(texts, (F.col("finish_position") % len(PHRASES) + 1).cast("int")).alias("text"),
    )


@query("X12_update_mentions", NAMED + """
SELECT doc_id || '/' || driver_number AS note_id, lower(code) AS description, 'driver_change' AS kind, 'medium' AS impact FROM named WHERE finish_position % 6 = 5""")
def _(spark, d):
    return x.update_mentions(notes(spark, d), "note_id")


@query("X12_update_mentions_documents", """WITH docs AS (SELECT doc_id, text || chr(10) || source || ' joins the team after the engine change' AS text FROM documents)
SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(\\w+)\\s+(?:replaces|replacing|joins|leaves)', 1) || regexp_extract_all(text, '(?i)driver\\s+change.*?(\\w+)', 1)
 || regexp_extract_all(text, '(?i)(\\w+)\\s+out.*?(?:injury|illness)', 1)) AS description, 'driver_change' AS kind, 'medium' AS impact FROM docs
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:upgrade|update|development).*?(\\w+)', 1) || regexp_extract_all(text, '(?i)(?:aerodynamic|engine|suspension).*?(?:improvement|change)')
 || regexp_extract_all(text, '(?i)new.*?(?:floor|wing|sidepod)')), 'technical_update', 'positive' FROM docs""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    text = F.concat("text", F.lit("\n"), "source", F.lit(" joins the team after the engine change"))
    return x.update_mentions(docs.select("doc_id", text.alias("text")))


@query("X13_extract_int", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\d+\\s*races?\\s*completed') THEN CAST(regexp_extract(text, '(?i)(\\d+)\\s*races?\\s*completed', 1) AS INTEGER)
 WHEN regexp_matches(text, '(?i)after\\s*\\d+\\s*rounds?') THEN CAST(regexp_extract(text, '(?i)after\\s*(\\d+)\\s*rounds?', 1) AS INTEGER)
 WHEN regexp_matches(text, '(?i)round\\s*\\d+') THEN CAST(regexp_extract(text, '(?i)round\\s*(\\d+)', 1) AS INTEGER) ELSE 0 END AS races_completed FROM documents""")
def _(spark, d):
    return x.extract_int(b.table(spark, d, "documents"))


@query("X13_extract_int_reports", NAMED + "SELECT doc_id, round_number AS races_completed FROM named WHERE finish_position = 1")
def _(spark, d):
    return x.extract_int(weekend(spark, d))


# --- pages ------------------------------------------------------------------------------
def result_pages(spark, d):
    """A result page per race with a header row and seven cells a row."""
    rows = texted(spark, d)
    cells = [
        place(rows), F.col("driver_number").cast("string"),
        F.concat(F.lit("<span> "), "name", F.lit(" </span>\n <span>"), "code", F.lit("</span>")),
        F.concat(F.lit("<a href='#'>"), "team", F.lit(" &amp; Co</a>")),
        F.col("laptime"), F.when(F.col("finish_position") <= 15, F.col("laptime")).otherwise(""),
        F.when(F.col("finish_position") <= 10, F.concat(F.lit("0:"), F.substring("laptime", 3, 9))).otherwise("NC"),
    ]
    line = F.concat(F.lit("<tr class='r'>"), *[p for c_ in cells for p in (F.lit("<td>"), c_, F.lit("</td>"))], F.lit("</tr>"))
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in ("Pos", "No", "Driver", "Team", "Q1", "Q2", "Q3")) + "</tr>\n<tr><td>ad</td></tr>"
    docs = documents_of(rows, line, head, "</table>")
    return docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))


CELL = "CASE WHEN finish_position <= 10 THEN '0:' || substring(laptime, 3) ELSE laptime END"


@query("X01_extract_html_rows", NAMED + f"""
SELECT doc_id AS page_id, finish_position AS position, CAST(driver_number AS VARCHAR) AS number, name AS driver, code AS driver_code, tname || ' & Co' AS team, laptime AS q1,
 CASE WHEN finish_position <= 15 THEN laptime ELSE '' END AS q2, CASE WHEN finish_position <= 10 THEN '0:' || substring(laptime, 3) ELSE 'NC' END AS q3, {CELL} AS time FROM named""")
def _(spark, d):
    return x.extract_html_rows(result_pages(spark, d))


@query("X01_html_cells_pages", r"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS "row", array_to_string([replace(replace(replace(replace(trim(regexp_replace(c, '\s*<[^>]*>\s*', '', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') FOR c IN regexp_extract_all(r, '(?is)<li[^>]*>(.*?)</li>', 1)], '|') AS cells
FROM (SELECT page_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1) AS rs FROM pages))""")
def _(spark, d):
    return x.html_cells(b.table(spark, d, "pages"), "ul", "li").withColumn("cells", F.array_join("cells", "|"))


@query("X02_best_time", NAMED + f"SELECT doc_id AS page_id, finish_position AS position, {CELL} AS time FROM named")
def _(spark, d):
    rows = x.extract_html_rows(result_pages(spark, d))
    return rows.select("page_id", "position", x.best_time(F.col("q1"), F.col("q2"), F.col("q3")).alias("time"))


@query("X03_split_code", f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Ann' WHEN s_suppkey % 3 = 1 THEN substring(s_name, 1, length(s_name) - 3) ELSE s_nationkey::VARCHAR END AS driver,
 CASE WHEN s_suppkey % 3 = 0 THEN {LETTERS.format('s_suppkey')} WHEN s_suppkey % 3 = 1 THEN right(s_name, 3) ELSE s_nationkey::VARCHAR END AS driver_code FROM supplier""")
def _(spark, d):
    n = F.col("s_suppkey")
    cell = F.when(n % 3 == 0, F.concat(F.lit("Ann "), b.letters(n))).when(n % 3 == 1, F.col("s_name")).otherwise(F.col("s_nationkey").cast("string"))
    return x.split_code(b.table(spark, d, "supplier").select("s_suppkey", cell.alias("driver_cell")))


@query("X04_grid_slots", NAMED + "SELECT doc_id AS page_id, code AS driver_code, max(finish_position) AS grid_position FROM named GROUP BY ALL")
def _(spark, d):
    return x.grid_slots(x.extract_html_rows(result_pages(spark, d)))


@query("X04_pole_rows", NAMED + f"SELECT doc_id AS page_id, name AS pole_position, {CELL} AS pole_time FROM named WHERE finish_position = 1")
def _(spark, d):
    return x.pole_rows(x.extract_html_rows(result_pages(spark, d)))


# --- query log --------------------------------------------------------------------------
STATEMENTS_SQL = """WITH log AS (SELECT conv_id, turn, role, text,
 CASE turn % 6 WHEN 0 THEN '  select * from t -- ' || replace(text, chr(10), ' ') || chr(10) || ' where x = 1' WHEN 1 THEN 'DELETE FROM t' WHEN 2 THEN '/* drop' || chr(10) || text || ' */ with a as (select 1) select * from a'
  WHEN 3 THEN 'select 1; drop table t' WHEN 4 THEN 'select updated, created_at from inserts' ELSE text END AS generated_sql FROM conversations)"""


def statements(spark, d):
    t, n = F.col("text"), F.col("turn") % 6
    sql = (F.when(n == 0, F.concat(F.lit("  select * from t -- "), F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\n where x = 1")))
           .when(n == 1, "DELETE FROM t").when(n == 2, F.concat(F.lit("/* drop\n"), t, F.lit(" */ with a as (select 1) select * from a")))
           .when(n == 3, "select 1; drop table t").when(n == 4, "select updated, created_at from inserts").otherwise(t))
    return b.table(spark, d, "conversations").withColumn("generated_sql", sql)


@query("X14_flag_unsafe_sql", STATEMENTS_SQL + r"""
SELECT conv_id, turn, regexp_extract(q, '^\s*(\S+)', 1) IN ('SELECT', 'WITH') AND NOT regexp_matches(q, '\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|MERGE|GRANT|REVOKE|EXEC|EXECUTE)\b') AS is_read_only
FROM (SELECT *, regexp_replace(regexp_replace(upper(generated_sql), '--.*?\n', '', 'g'), '(?s)/\*.*?\*/', '', 'g') AS q FROM log)""")
def _(spark, d):
    return x.flag_unsafe_sql(statements(spark, d), "generated_sql").select("conv_id", "turn", "is_read_only")
