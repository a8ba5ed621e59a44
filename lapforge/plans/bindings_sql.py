"""SQL form of the views in `bindings`, for DuckDB over the same tables."""

LAPS = """
raw_laps AS (
 SELECT CAST(year(l_shipdate) AS INTEGER) AS season_year,
  CAST((l_suppkey // 100) * 4 + quarter(l_shipdate) AS INTEGER) AS round_number,
  CAST(l_suppkey // 100 AS INTEGER) AS series,
  'Circuit ' || CAST((l_suppkey // 100) * 4 + quarter(l_shipdate) AS VARCHAR) AS circuit_name,
  CASE WHEN l_linenumber = 7 THEN 'FP1' ELSE 'RACE' END AS session_type,
  'D' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS driver_code,
  l_suppkey AS driver_number,
  CAST(date_diff('day', CAST(date_trunc('quarter', l_shipdate) AS DATE), CAST(l_shipdate AS DATE)) + 1 AS INTEGER) AS lap_number,
  CASE WHEN l_discount < 0.095 THEN 70 + l_quantity * 0.6 + l_extendedprice / 314159.265 END AS lap_time_seconds,
  22 + l_quantity * 0.2 + l_extendedprice / 923711.37 AS sector1_seconds,
  24 + l_tax * 50 + l_extendedprice / 718281.83 AS sector2_seconds,
  26 + l_discount * 50 + l_extendedprice / 1123581.3 AS sector3_seconds,
  CASE WHEN l_tax > 0.075 THEN 'UNKNOWN' WHEN l_returnflag = 'A' THEN 'SOFT'
       WHEN l_returnflag = 'N' THEN 'MEDIUM' ELSE 'HARD' END AS compound,
  l_orderkey AS load_id, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
 FROM lineitem),
laps AS (
 SELECT season_year, round_number, series, circuit_name, session_type, driver_code, driver_number, lap_number,
  lap_time_seconds, sector1_seconds, sector2_seconds, sector3_seconds, compound,
  CAST((lap_number - 1) % 23 + 1 AS INTEGER) AS tyre_life, CAST((lap_number - 1) // 23 + 1 AS INTEGER) AS stint, load_id
 FROM raw_laps
 QUALIFY row_number() OVER (PARTITION BY season_year, round_number, session_type, driver_code, lap_number
  ORDER BY load_id DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC,
   l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)"""

RACE_LAPS = LAPS + ", race_laps AS (SELECT * FROM laps WHERE session_type = 'RACE')"
TIMED_LAPS = LAPS + ", timed_laps AS (SELECT * FROM laps WHERE lap_time_seconds IS NOT NULL)"
PLACED_LAPS = TIMED_LAPS + """,
placed_laps AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY season_year, round_number, session_type, lap_number
  ORDER BY lap_time_seconds, driver_code) AS INTEGER) AS position FROM timed_laps)"""

RESULTS = RACE_LAPS + """,
sums AS (
 SELECT season_year, round_number, circuit_name, series, driver_code, driver_number,
  count(lap_time_seconds) AS n, sum(CAST(lap_time_seconds AS DECIMAL(18,3))) AS total, min(lap_time_seconds) AS best
 FROM race_laps GROUP BY ALL),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY season_year, round_number ORDER BY n DESC, total ASC NULLS LAST, driver_code) AS fin,
  row_number() OVER (PARTITION BY season_year, round_number ORDER BY best ASC NULLS LAST, driver_code) AS grid FROM sums),
results AS (
 SELECT season_year, round_number, circuit_name, series, driver_code, driver_number,
  'Team ' || CAST(series * 10 + driver_number % 10 AS VARCHAR) AS team,
  CAST(grid AS INTEGER) AS grid_position, CAST(CASE WHEN n >= 12 THEN fin END AS INTEGER) AS finish_position,
  CAST(CASE WHEN n < 12 THEN 0 WHEN fin = 1 THEN 25 WHEN fin = 2 THEN 18 WHEN fin = 3 THEN 15
            WHEN fin <= 10 THEN 11 - fin ELSE 0 END AS DOUBLE) AS points,
  CASE WHEN n >= 12 THEN 'Finished' ELSE 'Retired' END AS status
 FROM ranked)"""

ROSTER = """
roster AS (
 SELECT 'D' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS driver_code, s_name AS driver_name,
  'Team ' || CAST((s_suppkey // 100) * 10 + s_suppkey % 10 AS VARCHAR) AS team,
  CAST(s_suppkey // 100 AS INTEGER) AS series, s_acctbal > 9000 AS is_rookie, s_acctbal >= 0 AS is_active
 FROM supplier),
active AS (SELECT * EXCLUDE (is_active) FROM roster WHERE is_active)"""

STANDINGS = """
standings AS (
 SELECT season_year, series, driver_code, team, sum(points) AS points,
  CAST(row_number() OVER (PARTITION BY season_year, series ORDER BY sum(points) DESC, driver_code) AS INTEGER) AS position
 FROM results GROUP BY season_year, series, driver_code, team),
championship AS (SELECT * REPLACE (CAST(season_year + 1 AS INTEGER) AS season_year) FROM standings),
seasons AS (
 SELECT DISTINCT season_year, series FROM results r
 WHERE EXISTS (SELECT 1 FROM results p WHERE p.series = r.series AND p.season_year = r.season_year - 1))"""

DRIVERS = """
drivers AS (SELECT s.season_year, a.* FROM active a JOIN seasons s USING (series))"""

CIRCUITS = """
circuit_dim AS (
 SELECT 'circuit_' || CAST(p_partkey AS VARCHAR) AS circuit_key, 'Circuit ' || CAST(p_partkey AS VARCHAR) AS circuit_name,
  p_name AS nickname,
  CASE p_type WHEN 'ECONOMY' THEN 'street_circuit' WHEN 'SMALL' THEN 'high_speed'
   WHEN 'MEDIUM' THEN 'technical' WHEN 'LARGE' THEN 'mixed' END AS circuit_type,
  CASE WHEN p_size <= 8 THEN 'very_low' WHEN p_size <= 16 THEN 'low' WHEN p_size <= 24 THEN 'medium'
   WHEN p_size <= 32 THEN 'high' WHEN p_size <= 40 THEN 'very_high' END AS overtaking_difficulty,
  CASE WHEN p_size <= 40 THEN CAST(0.5 AS DOUBLE) + p_size / CAST(100 AS DOUBLE) END AS qualifying_importance,
  CASE WHEN p_size > 4 THEN (p_partkey % 10) / CAST(10 AS DOUBLE) END AS weather_sensitivity,
  string_split(p_name, ' ') AS key_factors,
  [p_retailprice / 10 - 95, p_retailprice / 5 - 190] AS coordinates,
  CASE WHEN p_size > 4 THEN CAST(0.5 AS DOUBLE) + p_size / CAST(100 AS DOUBLE) END AS regulation_similarity_weight,
  CASE WHEN p_size > 10 THEN [CAST(10 AS DOUBLE), CAST(10 AS DOUBLE) + p_size] END AS temperature_range,
  CASE WHEN p_size > 20 THEN p_size / CAST(100 AS DOUBLE) END AS rain_probability
 FROM part)"""

SAMPLES = """
weather_samples AS (
 SELECT 'Circuit ' || CAST(user_id % 4 + 1 AS VARCHAR) AS circuit_name, ts, value % 40 AS temperature,
  value % 97 AS humidity, value % 17 AS wind_speed, CASE WHEN event_type <> 'error' THEN value / 500 END AS pop,
  CASE WHEN event_type = 'signup' THEN value % 5 END AS rain_volume, event_type AS condition
 FROM events)"""

RECORDS = """
weather_records AS (
 SELECT CAST(year(o_orderdate) AS INTEGER) AS season_year,
  CAST((o_custkey // 1500) * 4 + quarter(o_orderdate) AS INTEGER) AS round_number,
  'Circuit ' || CAST((o_custkey // 1500) * 4 + quarter(o_orderdate) AS VARCHAR) AS circuit_name,
  'RACE' AS session_type, o_totalprice % 43 + (quarter(o_orderdate) - 2) * 9 AS air_temp, o_totalprice % 51 AS track_temp,
  o_totalprice % 101 AS humidity, 1000 + o_totalprice % 29 AS pressure, o_totalprice % 13 AS wind_speed,
  o_totalprice > 499500 AS rainfall
 FROM orders)"""


def with_views(*views: str) -> str:
    """Join view texts into one WITH clause."""
    return "WITH " + ",".join(views) + "\n"
