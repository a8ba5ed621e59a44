"""Queries over laps: filters, ordered windows, feature aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import cleaning as c
from lapforge.operators import laps as l
from lapforge.plans import bindings as b
from lapforge.plans import bindings_sql as s
from lapforge.plans.registry import query

KEY = "season_year, round_number, session_type, driver_code, lap_number"
STINT = "season_year, round_number, session_type, driver_code, stint"
DRIVER_RACE = "season_year, round_number, session_type, driver_code"
LAP = "season_year, round_number, session_type, lap_number"
T = "lap_time_seconds"


def keyed(df, *more):
    return df.select(*b.LAP_KEY, *more)


def rounded(name, places=6):
    return (F.round(name, places) + F.lit(0.0)).alias(name)


KEPT = """,
med AS (SELECT *, quantile_disc(lap_time_seconds, 0.5) OVER (PARTITION BY season_year, round_number, session_type, driver_code, stint) AS m
 FROM laps WHERE lap_time_seconds IS NOT NULL),
kept AS (SELECT * EXCLUDE (m) FROM med WHERE lap_time_seconds > 0 AND lap_time_seconds <= m * CAST(1.1 AS DOUBLE))"""


@query("P03_valid_laps", s.with_views(s.LAPS) + f"SELECT {KEY}, lap_time_seconds FROM laps WHERE driver_code <> '' AND lap_time_seconds > 0 AND lap_number IS NOT NULL")
def _(spark, d):
    return keyed(c.valid_laps(b.laps(spark, d)), T)


@query("P04_filter_outliers_long", """
WITH t AS (SELECT *, quantile_disc(l_extendedprice, 0.5) OVER (PARTITION BY year(l_shipdate)) AS mid FROM lineitem)
SELECT CAST(year(l_shipdate) AS INTEGER) AS season_year, l_orderkey * 8 + l_linenumber AS lap_number, l_extendedprice AS lap_time_seconds
FROM t WHERE l_extendedprice > 0 AND l_extendedprice <= mid * 1.1""")
def _(spark, d):
    """Groups of thousands of laps and distinct times, cut into blocks."""
    lines = b.table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("season_year"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lap_number"),
        F.col("l_extendedprice").alias("lap_time_seconds"),
    )
    return l.filter_outliers(lines, ["season_year"])


@query("P04_filter_outliers", s.with_views(s.LAPS + KEPT) + f"SELECT {KEY}, lap_time_seconds FROM kept")
def _(spark, d):
    return keyed(l.filter_outliers(b.laps(spark, d), spans=False), T)


@query("W01_stint_median", s.with_views(s.LAPS) + f"SELECT {STINT}, quantile_disc(lap_time_seconds, 0.5) AS median_lap FROM laps WHERE lap_time_seconds IS NOT NULL GROUP BY ALL")
def _(spark, d):
    timed = b.timed_laps(spark, d)
    keys = [*l.DRIVER_RACE, "stint"]
    return timed.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {T})").alias("median_lap"))


@query("P05_filter_vs_best", s.with_views(s.TIMED_LAPS) + f"SELECT {KEY}, lap_time_seconds FROM timed_laps QUALIFY lap_time_seconds <= min(lap_time_seconds) OVER (PARTITION BY {DRIVER_RACE}) * CAST(1.1 AS DOUBLE)")
def _(spark, d):
    return keyed(l.filter_vs_best(b.staged_laps(spark, d)), T)


@query("P06_clean_compound", s.with_views(s.LAPS) + f"SELECT {KEY}, compound, CASE WHEN upper(compound) IN ('NAN','NONE','UNKNOWN','') THEN NULL ELSE compound END AS clean_compound FROM laps")
def _(spark, d):
    return keyed(l.clean_compound(b.laps(spark, d)), "compound", "clean_compound")


@query("P08_where_eq", s.with_views(s.LAPS) + f"SELECT {KEY} FROM laps WHERE circuit_name = 'Circuit 1' AND compound = 'SOFT' AND session_type = 'RACE'")
def _(spark, d):
    return keyed(c.where_eq(b.laps(spark, d), circuit_name="Circuit 1", compound="SOFT", session_type="RACE"))


@query("P11_to_staging", s.with_views(s.LAPS) + f"SELECT {KEY}, lap_time_seconds FROM laps")
def _(spark, d):
    raw = b.laps(spark, d).withColumnsRenamed({"season_year": "year", "round_number": "round"})
    return keyed(c.to_staging(raw), T)


@query("P16_race_laps", s.with_views(s.LAPS) + f"SELECT {KEY}, lap_time_seconds FROM laps WHERE session_type = 'RACE' AND lap_time_seconds IS NOT NULL")
def _(spark, d):
    return keyed(c.race_laps(b.laps(spark, d)), T)


@query("S09_select_seasons", s.with_views(s.LAPS) + f"SELECT {KEY} FROM laps WHERE season_year = 1998")
def _(spark, d):
    return keyed(c.select_seasons(b.laps(spark, d), 1998))


@query("W02_lap_delta", s.with_views(s.TIMED_LAPS) + f"SELECT {KEY}, round(lap_time_seconds - lag(lap_time_seconds) OVER (PARTITION BY {STINT} ORDER BY lap_number), 6) + 0 AS lap_delta FROM timed_laps")
def _(spark, d):
    return keyed(l.lap_delta(b.timed_laps(spark, d), spans=False), rounded("lap_delta"))


@query("W03_rolling_delta", s.with_views(s.TIMED_LAPS) + f"""
SELECT {KEY}, round(avg(dl) OVER (PARTITION BY {STINT} ORDER BY lap_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0 AS rolling_delta_3
FROM (SELECT *, lap_time_seconds - lag(lap_time_seconds) OVER (PARTITION BY {STINT} ORDER BY lap_number) AS dl FROM timed_laps)""")
def _(spark, d):
    return keyed(l.rolling_delta(b.timed_laps(spark, d)), rounded("rolling_delta_3"))


@query("W04_stint_index", s.with_views(s.LAPS) + f"SELECT {KEY}, CAST(row_number() OVER (PARTITION BY {STINT} ORDER BY lap_number) AS INTEGER) AS stint_lap_index FROM laps")
def _(spark, d):
    return keyed(l.stint_index(b.laps(spark, d), spans=False), "stint_lap_index")


@query("W05_pace_delta", s.with_views(s.TIMED_LAPS) + f"SELECT {KEY}, lap_time_seconds - min(lap_time_seconds) OVER (PARTITION BY {LAP}) AS pace_delta_to_leader FROM timed_laps")
def _(spark, d):
    return keyed(l.pace_delta(b.staged_timed_laps(spark, d)), "pace_delta_to_leader")


@query("W06_rolling_consistency", s.with_views(s.TIMED_LAPS) + f"""
SELECT {KEY}, round(sd, 6) AS rolling_stddev_5, round(1.0 / (1.0 + coalesce(sd, 0)), 6) AS consistency_score
FROM (SELECT *, stddev_samp(lap_time_seconds) OVER (PARTITION BY {DRIVER_RACE} ORDER BY lap_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sd FROM timed_laps)""")
def _(spark, d):
    return keyed(l.rolling_consistency(b.timed_laps(spark, d), spans=False), rounded("rolling_stddev_5"), rounded("consistency_score"))


@query("W07_sector_deltas", s.with_views(s.LAPS) + f"""
SELECT {KEY}, {", ".join(f"round(sector{i}_seconds - avg(sector{i}_seconds) OVER (PARTITION BY {DRIVER_RACE}), 6) + 0 AS s{i}_delta" for i in (1, 2, 3))} FROM laps""")
def _(spark, d):
    return keyed(l.sector_deltas(b.laps(spark, d), spans=False), *[rounded(f"s{i}_delta") for i in (1, 2, 3)])


@query("W08_lap_rank", s.with_views(s.TIMED_LAPS) + f"SELECT {KEY}, CAST(rank() OVER (PARTITION BY {LAP} ORDER BY lap_time_seconds) AS INTEGER) AS lap_rank FROM timed_laps")
def _(spark, d):
    return keyed(l.lap_rank(b.timed_laps(spark, d), spans=False), "lap_rank")


FEATURED = KEPT + f""",
deltas AS (SELECT *, lap_time_seconds - lag(lap_time_seconds) OVER (PARTITION BY {STINT} ORDER BY lap_number) AS lap_delta FROM kept),
featured AS (SELECT *,
  avg(lap_delta) OVER (PARTITION BY {STINT} ORDER BY lap_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rolling_delta_3,
  lap_time_seconds - min(lap_time_seconds) OVER (PARTITION BY {LAP}) AS pace_delta_to_leader,
  CAST(1 AS DOUBLE) / (1 + coalesce(stddev_samp(lap_time_seconds) OVER (PARTITION BY {DRIVER_RACE} ORDER BY lap_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0)) AS consistency_score,
  sector1_seconds - avg(sector1_seconds) OVER (PARTITION BY {DRIVER_RACE}) AS s1_delta,
  sector2_seconds - avg(sector2_seconds) OVER (PARTITION BY {DRIVER_RACE}) AS s2_delta,
  sector3_seconds - avg(sector3_seconds) OVER (PARTITION BY {DRIVER_RACE}) AS s3_delta,
  CASE WHEN upper(compound) IN ('NAN','NONE','UNKNOWN','') THEN NULL ELSE compound END AS clean_compound
 FROM deltas)"""

FEATURE_SET = """
SELECT season_year, round_number, circuit_name, driver_code, count(*) AS total_laps,
 round(avg(lap_time_seconds), 3) + 0 AS avg_lap_time, round(min(lap_time_seconds), 3) AS fastest_lap,
 round(max(lap_time_seconds), 3) AS slowest_lap, round(stddev_samp(lap_time_seconds), 3) AS lap_time_stddev,
 round(avg(consistency_score), 3) + 0 AS avg_consistency, round(avg(pace_delta_to_leader), 3) + 0 AS avg_pace_delta,
 round(avg(lap_delta), 4) + 0 AS avg_degradation_per_lap, round(avg(rolling_delta_3), 4) + 0 AS avg_smoothed_degradation,
 count(DISTINCT stint) AS num_stints, count(DISTINCT clean_compound) AS num_compounds,
 first(clean_compound ORDER BY lap_number, clean_compound) FILTER (clean_compound IS NOT NULL) AS starting_compound,
 round(avg(s1_delta), 3) + 0 AS avg_s1_delta, round(avg(s2_delta), 3) + 0 AS avg_s2_delta, round(avg(s3_delta), 3) + 0 AS avg_s3_delta
FROM featured GROUP BY season_year, round_number, circuit_name, driver_code"""


@query("W09_race_feature_set", s.with_views(s.RACE_LAPS.replace("race_laps AS (SELECT", "unused AS (SELECT") + FEATURED.replace("FROM laps WHERE", "FROM laps WHERE session_type = 'RACE' AND")) + FEATURE_SET)
def _(spark, d):
    return l.race_feature_set(b.race_laps(spark, d), spans=False)


@query("A01_driver_race_features", s.with_views(s.LAPS + FEATURED) + FEATURE_SET)
def _(spark, d):
    return l.driver_race_features(l.lap_features(b.laps(spark, d), spans=False), spans=False)


NEAR = f""",
near AS (SELECT *, lap_time_seconds <= min(lap_time_seconds) OVER (PARTITION BY {DRIVER_RACE}) * CAST(1.1 AS DOUBLE) AS ok FROM timed_laps),
cons AS (SELECT {DRIVER_RACE}, count(*) AS valid_laps, CASE WHEN count(*) <= 1 THEN 1.0 WHEN count(*) FILTER (ok) <= 1 THEN 0.5
  ELSE greatest(0.0, 1.0 - stddev_samp(lap_time_seconds) FILTER (ok) / avg(lap_time_seconds) FILTER (ok) * 10) END AS consistency
 FROM near GROUP BY ALL)"""


@query("A30_lap_consistency", s.with_views(s.TIMED_LAPS + NEAR) + f"SELECT {DRIVER_RACE}, valid_laps, CAST(round(consistency, 6) AS DOUBLE) AS consistency FROM cons")
def _(spark, d):
    return l.lap_consistency(b.laps(spark, d), spans=False).withColumn("consistency", F.round("consistency", 6))


@query("A29_session_summary", s.with_views(s.PLACED_LAPS + """,
pos AS (SELECT l.*, p.position FROM laps l LEFT JOIN placed_laps p USING (season_year, round_number, session_type, driver_code, lap_number))""" + NEAR) + f"""
SELECT season_year, round_number, session_type, driver_code, count(*) AS total_laps, any_value(valid_laps) AS valid_laps,
 min(lap_time_seconds) AS fastest_lap, round(avg(lap_time_seconds), 6) AS average_lap,
 CAST(round(any_value(consistency), 6) AS DOUBLE) AS consistency,
 array_to_string(list_sort(list_distinct(list(position))), ',') AS positions
FROM pos JOIN cons USING ({DRIVER_RACE}) GROUP BY ALL""")
def _(spark, d):
    laps = b.staged_laps(spark, d)
    placed = b.placed_laps(spark, d).select(*b.LAP_KEY, "position")
    out = l.session_summary(laps.join(placed, b.LAP_KEY, "left"))
    return out.select(
        *l.DRIVER_RACE, "total_laps", "valid_laps", "fastest_lap", rounded("average_lap"), rounded("consistency"),
        F.array_join("positions", ",").alias("positions"),
    )


@query("R08_gap_to_leader", s.with_views(s.TIMED_LAPS) + f"""
SELECT {KEY}, round(rt - min(rt) OVER (PARTITION BY {LAP}), 4) + 0 AS gap_to_leader
FROM (SELECT *, sum(lap_time_seconds) OVER (PARTITION BY {DRIVER_RACE} ORDER BY lap_number ROWS UNBOUNDED PRECEDING) AS rt FROM timed_laps)""")
def _(spark, d):
    return keyed(l.gap_to_leader(b.staged_timed_laps(spark, d), spans=False), rounded("gap_to_leader", 4))


@query("W18_order_fraction", s.with_views(s.PLACED_LAPS) + f"SELECT {KEY}, round((position - 1) / greatest(count(*) OVER (PARTITION BY {LAP}) - 1, 1), 6) AS order_fraction FROM placed_laps")
def _(spark, d):
    return keyed(l.order_fraction(b.placed_laps(spark, d)), rounded("order_fraction"))


@query("W20_wear_fraction", s.with_views(s.LAPS) + f"SELECT {KEY}, round(tyre_life / max(tyre_life) OVER (PARTITION BY {STINT}), 6) AS wear_fraction FROM laps")
def _(spark, d):
    return keyed(l.wear_fraction(b.laps(spark, d), spans=False), rounded("wear_fraction"))


@query("W10_dedup_latest", s.with_views(s.LAPS) + f"SELECT {KEY}, lap_time_seconds, load_id FROM laps")
def _(spark, d):
    return keyed(b.laps(spark, d), T, "load_id")


@query("A09_count_by_season", s.with_views(s.LAPS) + "SELECT season_year, count(*) AS n FROM laps GROUP BY 1")
def _(spark, d):
    return b.laps(spark, d).groupBy("season_year").agg(F.count(F.lit(1)).alias("n"))


@query("U02_event_keys", s.with_views(s.LAPS) + "SELECT DISTINCT season_year, round_number, circuit_name FROM laps")
def _(spark, d):
    return c.event_keys(b.raw_laps(spark, d))
