"""Queries that write tables or streams to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.operators import cleaning as c
from lapforge.operators import laps as l
from lapforge.plans import bindings as b
from lapforge.plans import bindings_sql as s
from lapforge.plans.history_queries import WEATHER
from lapforge.plans.registry import SQL, query, rounded, rounded_sql
from lapforge.plans.text_queries import KEY
from lapforge.schemas import RACE_DOCUMENT, schema
from lapforge.session import few_state_partitions, shared_folder
from lapforge.sources import readers as rd
from lapforge.sources import writers as wr
from lapforge.streaming import ingest as st
from lapforge.streaming import stateful as sf

V = s.with_views
RESULTS = V(s.RESULTS)
LAPS = V(s.LAPS)


def scratch(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lapforge/{name}-{uuid.uuid4().hex[:12]}"


LAP_COLUMNS = [*b.LAP_KEY, "circuit_name", "lap_time_seconds", "compound", "stint"]
LAP_SQL = LAPS + f"SELECT {KEY}, circuit_name, lap_time_seconds, compound, stint FROM laps"


@query("S01_read_laps", LAP_SQL)
def _(spark, d):
    path = scratch(spark, "laps")
    rows = b.laps(spark, d).select(*LAP_COLUMNS)
    wr.write_features(rows, path)
    return rd.read_laps(spark, path, rows.schema)


@query("S02_read_warehouse", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return counted(rd.read_warehouse(spark, f"{d}/lineitem.parquet", "parquet"), "l_returnflag")


def counted(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def raw_timing(spark, d):
    """Laps the way a timing feed gives them: durations as intervals, numbers as floats."""
    span = lambda col: F.make_dt_interval(secs=F.col(col).cast("decimal(18,6)"))
    laps = b.laps(spark, d)
    return laps.select(
        F.col("season_year").alias("year"), F.col("round_number").alias("round"), "circuit_name", F.lower("session_type").alias("session_type"),
        F.col("driver_code").alias("Driver"), F.col("lap_number").cast("double").alias("LapNumber"), span("lap_time_seconds").alias("LapTime"),
        span("sector1_seconds").alias("Sector1Time"), span("sector2_seconds").alias("Sector2Time"), span("sector3_seconds").alias("Sector3Time"),
        F.col("compound").alias("Compound"), F.when(F.col("tyre_life") > 2, F.col("tyre_life").cast("double")).otherwise(float("nan")).alias("TyreLife"),
        F.col("stint").cast("double").alias("Stint"), F.lit(None).cast("double").alias("Position"),
    )


MS = "CAST(round(CAST({0} AS DECIMAL(18,6)), 3) AS DOUBLE) AS {0}"


@query("S03_ingest_laps", LAPS + f"""SELECT season_year AS year, round_number AS round, circuit_name, session_type, driver_code, lap_number,
 {", ".join(MS.format(x) for x in ("lap_time_seconds", "sector1_seconds", "sector2_seconds", "sector3_seconds"))}, compound,
 CASE WHEN tyre_life > 2 THEN tyre_life END AS tyre_life, stint, CAST(NULL AS INTEGER) AS position FROM laps WHERE lap_time_seconds > 0""")
def _(spark, d):
    return rd.ingest_laps(raw_timing(spark, d))


@query("S04_read_season_csv", RESULTS + "SELECT circuit_name AS \"Track\", coalesce(CAST(finish_position AS VARCHAR), 'NC') AS \"Position\", CAST(driver_number AS VARCHAR) AS \"No\", driver_code AS \"Driver\", team AS \"Team\", points AS \"Points\" FROM results")
def _(spark, d):
    path = scratch(spark, "season")
    place = F.coalesce(F.col("finish_position").cast("string"), F.lit("NC"))
    rows = b.results(spark, d).select(
        F.col("circuit_name").alias("Track"), place.alias("Position"), F.col("driver_number").cast("string").alias("No"),
        F.col("driver_code").alias("Driver"), F.col("team").alias("Team"), F.col("points").alias("Points"))
    wr.export(rows, path, "csv")
    return rd.read_season_csv(spark, path)


@query("S05_read_dimension_json", """SELECT 'circuit_' || p_partkey AS circuit_key, p_name AS name, CASE WHEN p_size > 20 THEN p_size / CAST(100 AS DOUBLE) END AS qualifying_importance, string_split(p_name, ' ')[1] AS factor FROM part""")
def _(spark, d):
    path = scratch(spark, "dimension")
    body = F.struct(
        F.array("p_name").alias("official_names"), F.when(F.col("p_size") > 20, F.col("p_size") / 100.0).alias("qualifying_importance"),
        F.split("p_name", " ").alias("key_factors"))
    key = F.concat(F.lit("circuit_"), F.col("p_partkey").cast("string"))
    # A file per hundred parts: a dimension file is one object and read whole.
    hundred = F.floor(F.col("p_partkey") / 100)
    objects = b.table(spark, d, "part").groupBy(hundred).agg(F.map_from_entries(F.collect_list(F.struct(key, body))).alias("m"))
    objects.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    dim = rd.read_dimension_json(spark, path, "circuit_key")
    return dim.select("circuit_key", F.element_at("official_names", 1).alias("name"), "qualifying_importance", F.element_at("key_factors", 1).alias("factor"))


@query("S06_read_seed", "SELECT p_partkey AS circuit, p_size / CAST(100 AS DOUBLE) AS regulation_similarity_weight FROM part")
def _(spark, d):
    path = scratch(spark, "seed")
    rows = b.table(spark, d, "part").select(F.col("p_partkey").alias("circuit"), (F.col("p_size") / 100.0).alias("regulation_similarity_weight"))
    wr.export(rows, path, "csv")
    return rd.read_seed(spark, path, schema("circuit:long regulation_similarity_weight:double"))


@query("S07_summarize_files", RESULTS + """
SELECT season_year || '-' || round_number AS race, count(*) AS results_count, true AS available, 2 AS attempts,
 string_agg(driver_code || ' - ' || CASE WHEN points > 0 THEN CAST(CAST(points AS INTEGER) AS VARCHAR) ELSE 'No time' END, '; ' ORDER BY grid_position) FILTER (grid_position <= 3) AS top_3
FROM results GROUP BY season_year, round_number""")
def _(spark, d):
    path = scratch(spark, "parsed")
    row = F.struct(F.col("grid_position").alias("position"), F.col("driver_code").alias("driver"),
                   F.when(F.col("points") > 0, F.col("points").cast("int").cast("string")).alias("time"))
    files = b.results(spark, d).groupBy("season_year", "round_number").agg(F.array_sort(F.collect_list(row)).alias("results"))
    body = F.struct(F.lit(True).alias("available"), "results", F.array(F.lit("table"), F.lit("list")).alias("parsing_attempts"))
    files.select("season_year", "round_number", F.to_json(body).alias("value")).write.partitionBy("season_year", "round_number").text(path)
    out = rd.summarize_files(spark, path)
    return out.select(
        F.concat_ws("-", "season_year", "round_number").alias("race"), F.col("results_count").cast("long").alias("results_count"),
        "available", "attempts", F.array_join("top_3", "; ").alias("top_3"))


def race_documents(spark, d):
    """Results and laps packed into one nested document per race (at most a hundred drivers)."""
    race = ["season_year", "round_number", "circuit_name"]
    entry = F.struct(
        F.col("driver_code").alias("name"), "team", F.col("finish_position").alias("race_position"), F.lit(None).cast("int").alias("grid_position"),
        F.col("grid_position").alias("qualifying_position"), F.col("points").alias("race_points"), F.col("status").alias("race_status"))
    res = b.results(spark, d)
    drivers = res.groupBy(*race).agg(
        F.map_from_entries(F.collect_list(F.struct("driver_code", entry))).alias("drivers"),
        F.max(F.when(F.col("finish_position") == 1, F.col("driver_code"))).alias("race_winner"),
        F.collect_list(F.struct(
            F.when(F.col("grid_position") != 2, F.col("driver_code")).alias("driver_code"), F.col("driver_code").alias("driver_name"), "team",
            F.col("grid_position").alias("position"), F.lit(None).cast("string").alias("q1_time"), F.lit(None).cast("string").alias("q2_time"), F.lit(None).cast("string").alias("q3_time"))).alias("raw_qualifying"))
    lap = F.struct(
        F.lit(None).cast("string").alias("session_type"), "driver_code", "lap_number", "lap_time_seconds", "sector1_seconds", "sector2_seconds", "sector3_seconds",
        "compound", "tyre_life", "stint", F.lit(None).cast("int").alias("position"), F.lit(None).cast("boolean").alias("is_personal_best"))
    sessions = b.laps(spark, d).groupBy(*race, "session_type").agg(F.collect_list(lap).alias("raw_laps"))
    kinds = RACE_DOCUMENT["sessions"].dataType.valueType
    pairs = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", kinds)]))
    session = F.struct("raw_laps", F.lit(None).cast(kinds["raw_qualifying"].dataType).alias("raw_qualifying"))
    by_name = sessions.groupBy(*race).agg(F.collect_list(F.struct("session_type", session)).cast(pairs).alias("packed"))
    sky = b.weather_records(spark, d).groupBy("season_year", "round_number").agg(F.avg("air_temp").alias("air_temp_avg"), F.bool_or("rainfall").alias("rainfall"))
    none = F.lit(None).cast("double")
    quali = F.array(F.struct(F.lit("Qualifying"), F.struct(F.lit(None).cast(kinds["raw_laps"].dataType).alias("raw_laps"), "raw_qualifying"))).cast(pairs)
    return drivers.join(by_name, race, "left").join(sky, ["season_year", "round_number"], "left").select(
        F.col("season_year").alias("year"), F.col("round_number").alias("round"), "circuit_name", "race_winner", "drivers",
        F.map_from_entries(F.concat(F.col("packed"), quali)).alias("sessions"),
        F.struct(F.col("rainfall").isNotNull().alias("available"), "air_temp_avg", none.alias("track_temp_avg"), none.alias("humidity_avg"),
                 none.alias("pressure_avg"), none.alias("wind_speed_avg"), "rainfall").alias("weather"))


@query("S08_flatten_results", RESULTS + "SELECT season_year AS year, round_number AS round, circuit_name, driver_code, driver_code AS driver_name, team, grid_position, finish_position, points, status FROM results")
def _(spark, d):
    return rd.flatten_races(race_documents(spark, d))["race_results"]


@query("S08_flatten_qualifying", RESULTS + "SELECT season_year AS year, round_number AS round, circuit_name, driver_code, team, grid_position AS position FROM results WHERE grid_position <> 2")
def _(spark, d):
    return rd.flatten_races(race_documents(spark, d))["qualifying_results"].select("year", "round", "circuit_name", "driver_code", "team", "position")


@query("S08_flatten_laps", LAPS + "SELECT season_year AS year, round_number AS round, circuit_name, session_type, driver_code, lap_number, lap_time_seconds, compound, tyre_life, stint FROM laps")
def _(spark, d):
    flat = rd.flatten_races(race_documents(spark, d))["lap_times"]
    return flat.select("year", "round", "circuit_name", "session_type", "driver_code", "lap_number", "lap_time_seconds", "compound", "tyre_life", "stint")


@query("S08_flatten_weather", rounded_sql(V(s.RESULTS, WEATHER), """SELECT DISTINCT w.season_year AS year, w.round_number AS round, w.circuit_name, w.session_type, w.air_temp_avg, w.rainfall
 FROM session_weather w JOIN results r USING (season_year, round_number)""", "air_temp_avg"))
def _(spark, d):
    return rounded(rd.flatten_races(race_documents(spark, d))["weather"].select("year", "round", "circuit_name", "session_type", "air_temp_avg", "rainfall"))


# --- sinks ------------------------------------------------------------------------------
@query("K01_write_features", RESULTS + "SELECT season_year, round_number, driver_code, points FROM results")
def _(spark, d):
    path = scratch(spark, "features")
    wr.write_features(b.results(spark, d).select("season_year", "round_number", "driver_code", "points"), path)
    return spark.read.parquet(path)


def appended(spark, d):
    path = scratch(spark, "append")
    wr.append_table(b.laps(spark, d).select(*LAP_COLUMNS), path)
    return path


@query("K02_append_table", LAP_SQL + " UNION ALL " + LAP_SQL[len(LAPS):].replace("FROM laps", "FROM laps WHERE season_year = 1999"))
def _(spark, d):
    path = appended(spark, d)
    wr.append_table(b.laps(spark, d).select(*LAP_COLUMNS).filter("season_year = 1999"), path)
    return spark.read.parquet(path)


@query("K03_replace_events", LAPS + f"SELECT {KEY}, CASE WHEN season_year = 1999 THEN 'RELOADED' ELSE compound END AS compound FROM laps")
def _(spark, d):
    path = scratch(spark, "events")
    laps = b.laps(spark, d).select(*b.LAP_KEY, "compound")
    wr.replace_events(laps, path)
    # A whole season is delivered again, twice.
    again = c.select_seasons(laps, 1999).withColumn("compound", F.lit("RELOADED"))
    wr.replace_events(again, path)
    wr.replace_events(again, path)
    return rd.read_table(spark, path).select(*b.LAP_KEY, "compound")


@query("K04_repartition_table", LAP_SQL)
def _(spark, d):
    dst = scratch(spark, "moved")
    wr.repartition_table(spark, appended(spark, d), dst, ["season_year", "round_number"], ["circuit_name"])
    return rd.read_table(spark, dst).select(*LAP_COLUMNS)


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("K05_compact_dedup", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(x + " DESC" for x in LINE_ORDER)}) = 1""")
def _(spark, d):
    dst = scratch(spark, "compact")
    order = [F.col(x).desc() for x in LINE_ORDER]
    wr.compact_dedup(spark, f"{d}/lineitem.parquet", dst, ["l_orderkey", "l_linenumber"], order)
    return spark.read.parquet(dst).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("K06_export_json", RESULTS + "SELECT driver_code, season_year, round_number, team, points FROM results")
def _(spark, d):
    path = scratch(spark, "json")
    rows = b.results(spark, d).select("driver_code", "season_year", "round_number", "team", "points")
    wr.export(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("K06_export_csv", RESULTS + "SELECT driver_code, season_year, round_number, team, points FROM results")
def _(spark, d):
    path = scratch(spark, "csv")
    rows = b.results(spark, d).select("driver_code", "season_year", "round_number", "team", "points")
    wr.export(rows, path, "csv")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


LOG_SQL = """WITH log AS (SELECT DATE '2024-01-01' + CAST(conv_id % 7 AS INTEGER) AS day, text AS question, repeat(text, 3) AS response, role <> 'system' AS success,
 CASE WHEN role = 'system' THEN 'refused' ELSE '' END AS error, CAST(length(text) AS DOUBLE) AS latency_ms, role AS model_used, conv_id * 10 + turn AS estimated_bytes FROM conversations) """


def log(spark, d):
    talk = b.table(spark, d, "conversations")
    rows = talk.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 7).cast("int")).cast("timestamp").alias("timestamp"),
        F.col("text").alias("question"), F.lit("").alias("generated_sql"), F.repeat("text", F.lit(3)).alias("response"), (F.col("role") != "system").alias("success"),
        F.when(F.col("role") == "system", "refused").alias("error"), F.length("text").cast("double").alias("latency_ms"), F.col("role").alias("model_used"),
        (F.col("conv_id") * 10 + F.col("turn")).alias("estimated_bytes"))
    path = scratch(spark, "log")
    wr.append_query_log(rows, path)
    return spark.read.parquet(path)


@query("K07_append_query_log", LOG_SQL + "SELECT question, response, success, error, estimated_bytes FROM log")
def _(spark, d):
    return log(spark, d).select("question", "response", "success", "error", "estimated_bytes")


@query("A36_query_log_stats", LOG_SQL + """SELECT model_used, CAST(day AS VARCHAR) AS day, count(*) AS queries, round(avg(success::INT), 6) AS success_rate, quantile_disc(latency_ms, 0.5) AS latency_p50,
 quantile_disc(latency_ms, 0.95) AS latency_p95, CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes FROM log GROUP BY ALL""")
def _(spark, d):
    return rounded(wr.query_log_stats(log(spark, d)).withColumn("day", F.col("day").cast("string")))


# --- streams ----------------------------------------------------------------------------
LIVE = ["year", "round", "circuit_name", "driver_code", "lap_number", "lap_time_seconds", "compound", "tyre_life"]


def live(spark, d):
    """Race laps as they go out live."""
    laps = b.race_laps(spark, d)
    return laps.select(F.col("season_year").alias("year"), F.col("round_number").alias("round"), *LIVE[2:])


LIVE_SQL = V(s.RACE_LAPS) + "SELECT season_year AS year, round_number AS round, circuit_name, driver_code, lap_number, lap_time_seconds, compound, tyre_life FROM race_laps"


def messages(spark, d, copies=1):
    """Live laps as JSON lines, packed, with one broken line per driver and race."""
    rows = live(spark, d)
    if copies > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    path = scratch(spark, "messages")
    first = F.col("lap_number") == 1
    lines = F.explode(F.when(first, F.array(F.to_json(F.struct(*LIVE)), F.lit("{broken"))).otherwise(F.array(F.to_json(F.struct(*LIVE)))))
    rows.select(lines.alias("value")).write.text(path, compression="gzip")
    return path


def flushed(spark, stream, name):
    """Run a stream to completion and read its sink."""
    path, state = scratch(spark, name), scratch(spark, "state")
    st.drain(st.microbatch(stream, path, state, seconds=None), None)
    return path


@query("S10_read_lap_stream", LIVE_SQL)
def _(spark, d):
    stream = st.decode(st.read_lap_stream(spark, "text", path=messages(spark, d)))
    return spark.read.parquet(flushed(spark, stream, "live")).select(*LIVE)


@query("R01_decode", LIVE_SQL)
def _(spark, d):
    return st.decode(spark.read.text(messages(spark, d))).select(*LIVE)


@query("R02_stamp_published", LIVE_SQL)
def _(spark, d):
    stream = st.stamp_published(st.decode(st.read_lap_stream(spark, "text", path=messages(spark, d))))
    sink = spark.read.parquet(flushed(spark, stream, "live"))
    return sink.filter("published_at IS NOT NULL").select(*LIVE)


SLICE = 20_000  # rows of a replayed slice


@query("S11_replay", LIVE_SQL)
def _(spark, d):
    return spark.read.parquet(flushed(spark, st.replay(live(spark, d), scratch(spark, "replay"), SLICE), "live")).select(*LIVE)


@query("R03_microbatch_order", V(s.RACE_LAPS) + "SELECT count(*) AS laps, true AS in_order FROM race_laps")
def _(spark, d):
    """Replayed batches follow each other: no batch holds a lap before one of an earlier batch."""
    sink = spark.read.parquet(flushed(spark, st.replay(live(spark, d), scratch(spark, "replay"), SLICE), "live"))
    spans = sink.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("lap_number").alias("low"), F.max("lap_number").alias("high"))
    # Batches by slice: each starts where the one before it has ended.
    before = spans.select((F.col("batch_id") + 1).alias("batch_id"), F.col("high").alias("reached"))
    ok = F.coalesce(F.min(F.col("low") >= F.col("reached")), F.lit(True))
    return spans.join(before, "batch_id", "left").agg(F.sum("n").alias("laps"), ok.alias("in_order"))


# Arrivals: laps of a race a second apart at first, each driver a little later than the one before;
# late laps come slowly, so that flushes end by time as well as by rows.
ARRIVAL_SQL = """,
arrivals AS (
 SELECT season_year AS year, round_number AS round, driver_code, lap_number,
  lap_number * CASE WHEN lap_number <= 60 THEN 1000 ELSE 1500 END + (driver_number * 37) % 700 AS ms
 FROM race_laps)"""


def arrivals(spark, d):
    ms = F.col("lap_number") * F.when(F.col("lap_number") <= 60, 1000).otherwise(1500) + (F.col("driver_number") * 37) % 700
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return b.race_laps(spark, d).select(
        F.col("season_year").alias("year"), F.col("round_number").alias("round"), "driver_code", "lap_number", "lap_time_seconds",
        F.timestamp_micros(F.unix_micros(start) + ms * 1000).alias("published_at"),
    )


@query("R03_flushes", V(s.RACE_LAPS).replace("WITH", "WITH RECURSIVE", 1) + ARRIVAL_SQL + """,
seq AS (SELECT year, round, ms, row_number() OVER (PARTITION BY year, round ORDER BY ms, driver_code, lap_number) AS i FROM arrivals),
steps AS (
 SELECT year, round, i, 1 AS flush, 1 AS held, ms AS opened FROM seq WHERE i = 1
 UNION ALL
 SELECT q.year, q.round, q.i, CASE WHEN held >= 50 OR q.ms - opened >= 2000 THEN flush + 1 ELSE flush END,
  CASE WHEN held >= 50 OR q.ms - opened >= 2000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 50 OR q.ms - opened >= 2000 THEN q.ms ELSE opened END
 FROM steps p JOIN seq q ON q.year = p.year AND q.round = p.round AND q.i = p.i + 1),
listed AS (SELECT year, round, flush, count(*) AS rows, max(flush) OVER (PARTITION BY year, round) AS final FROM steps GROUP BY year, round, flush)
SELECT year, round, CAST(flush AS INTEGER) AS flush, rows, CASE WHEN rows >= 50 THEN 'rows' WHEN flush = final THEN 'open' ELSE 'seconds' END AS reason, true AS in_time FROM listed""")
def _(spark, d):
    """Every flush of the live path: none above 50 rows, none open for 2 seconds or more."""
    stream = st.replay(arrivals(spark, d), scratch(spark, "replay"), SLICE, order=("published_at", "driver_code", "lap_number"))
    cut = sf.cut_flushes(stream, ["year", "round"], "published_at")
    with few_state_partitions(spark):
        sink = flushed(spark, cut, "live")
    log = sf.flush_log(spark.read.parquet(sink), ["year", "round"], "published_at")
    in_time = F.unix_micros("last_arrival") - F.unix_micros("first_arrival") < 2_000_000
    return log.select("year", "round", "flush", "rows", "reason", in_time.alias("in_time"))


@query("R08_streamed_gap", V(s.TIMED_LAPS) + """
SELECT season_year AS year, round_number AS round, driver_code, lap_number, round(rt - min(rt) OVER (PARTITION BY season_year, round_number, lap_number), 4) + 0 AS gap_to_leader
FROM (SELECT *, sum(lap_time_seconds) OVER (PARTITION BY season_year, round_number, driver_code ORDER BY lap_number ROWS UNBOUNDED PRECEDING) AS rt FROM timed_laps WHERE session_type = 'RACE')""")
def _(spark, d):
    """Gaps kept up to date while laps arrive in no order at all; the last versions are those of the whole race."""
    mixed = arrivals(spark, d).withColumn("turn", F.xxhash64("year", "round", "driver_code", "lap_number"))
    stream = st.replay(mixed, scratch(spark, "replay"), SLICE, order=("turn",))
    path, state = scratch(spark, "gaps"), scratch(spark, "state")
    with few_state_partitions(spark):
        query = st.microbatch(sf.live_gaps(stream, ["year", "round"]), path, state, seconds=None, mode="update")
    st.drain(query, None)
    gaps = sf.latest_gaps(spark.read.parquet(path), ["year", "round", "driver_code", "lap_number"])
    return gaps.select("year", "round", "driver_code", "lap_number", (F.round("gap_to_leader", 4) + 0.0).alias("gap_to_leader"))


@query("R04_append_live", LIVE_SQL)
def _(spark, d):
    path, state = scratch(spark, "live"), scratch(spark, "state")
    stream = st.replay(live(spark, d), scratch(spark, "replay"), SLICE)
    st.drain(st.microbatch(stream, path, state, seconds=None), None)
    # A batch delivered again replaces itself.
    run = spark.read.parquet(path).select("run").first()["run"]
    first = spark.read.parquet(f"{path}/run={run}/batch_id=0")
    kept = scratch(spark, "kept")
    first.write.parquet(kept)
    st.append_live(spark.read.schema(first.schema).parquet(kept), path, 0, run)
    return spark.read.parquet(path).select(*LIVE)


@query("R05_drain", V(s.RACE_LAPS) + "SELECT season_year AS year, count(*) AS n FROM race_laps GROUP BY 1")
def _(spark, d):
    stream = st.decode(st.read_lap_stream(spark, "text", path=messages(spark, d), maxFilesPerTrigger="2"))
    return counted(spark.read.parquet(flushed(spark, stream, "live")), "year")


@query("R06_reconcile", V(s.RACE_LAPS) + """SELECT season_year AS year, round_number AS round, count(*) AS loaded_rows, count(*) AS expected_rows, count(DISTINCT lap_number) AS laps, count(DISTINCT driver_code) AS drivers, true AS complete FROM race_laps GROUP BY ALL""")
def _(spark, d):
    stream = st.decode(st.read_lap_stream(spark, "text", path=messages(spark, d)))
    return st.reconcile(spark, flushed(spark, stream, "live"), live(spark, d), ["year", "round"])


FAULTS_SQL = """,
faulty AS (SELECT *, (driver_number + lap_number) % 53 = 0 AS lost, (driver_number + lap_number) % 53 = 1 AS doubled,
  (driver_number + lap_number) % 53 = 2 AND lap_time_seconds IS NOT NULL AS changed FROM race_laps WHERE round_number % 4 > 0),
faults AS (SELECT season_year, round_number, count(*) FILTER (lost) AS l, count(*) FILTER (doubled) AS d, count(*) FILTER (changed) AS c FROM faulty GROUP BY ALL)"""


@query("R06_reconcile_content", V(s.RACE_LAPS) + FAULTS_SQL + """
SELECT season_year AS year, round_number AS round, count(*) AS expected_rows, count(*) - coalesce(any_value(l), 0) + coalesce(any_value(d), 0) AS loaded_rows,
 coalesce(any_value(l), 0) AS lost_rows, coalesce(any_value(d), 0) AS doubled_rows, coalesce(any_value(c), 0) AS changed_rows, coalesce(any_value(l + d + c), 0) = 0 AS same
FROM race_laps LEFT JOIN faults USING (season_year, round_number) GROUP BY ALL""")
def _(spark, d):
    """A sink with faults in three of four rounds, some of which leave the counts as they were."""
    wanted = live(spark, d)
    n = (F.substring("driver_code", 2, 9).cast("long") + F.col("lap_number")) % 53
    bad = F.col("round") % 4 > 0
    copies = F.when(bad & (n == 0), 0).when(bad & (n == 1), 2).otherwise(1)
    time = F.when(bad & (n == 2), F.col("lap_time_seconds") + 1).otherwise(F.col("lap_time_seconds"))
    spoiled = wanted.withColumn("lap_time_seconds", time).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("copy")
    path = scratch(spark, "spoiled")
    spoiled.write.parquet(path)
    return st.reconcile_content(
        spark.read.parquet(path), wanted, ["year", "round"], ["driver_code", "lap_number"], ["lap_time_seconds", "compound", "tyre_life"])


@query("R07_redelivered_late", LIVE_SQL)
def _(spark, d):
    """Laps sent again days later, beyond any watermark, and in another batch than the first time."""
    first = live(spark, d).withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    again = first.withColumn("published_at", F.lit("2024-01-09").cast("timestamp"))
    stream = st.replay(first.unionByName(again), scratch(spark, "replay"), SLICE, order=("published_at", "lap_number", "driver_code"))
    path, state = scratch(spark, "live"), scratch(spark, "state")
    keys = ["year", "round", "driver_code", "lap_number"]
    with few_state_partitions(spark):
        query = st.microbatch(stream, path, state, seconds=None, once=keys, event=["year", "round"])
    st.drain(query, None)
    return spark.read.parquet(path).select(*LIVE)


@query("R07_dedup_stream", LIVE_SQL)
def _(spark, d):
    keys = ["year", "round", "driver_code", "lap_number"]
    stream = st.decode(st.read_lap_stream(spark, "text", path=messages(spark, d, copies=3)))
    stamped = st.stamp_published(stream, F.lit("2024-01-01").cast("timestamp"))
    return spark.read.parquet(flushed(spark, st.dedup_stream(stamped, keys, "published_at"), "live")).select(*LIVE)


@query("R07_dedup_batch", LIVE_SQL)
def _(spark, d):
    rows = st.decode(spark.read.text(messages(spark, d, copies=3)))
    keys = ["year", "round", "driver_code", "lap_number"]
    return c.dedup_latest(rows, keys, [F.col("lap_time_seconds").desc()]).select(*LIVE)


@query("A01_streamed_features", SQL["W09_race_feature_set"])
def _(spark, d):
    """Features over laps that came through the stream; equal to those of the batch."""
    path = flushed(spark, st.replay(b.race_laps(spark, d), scratch(spark, "replay"), SLICE), "live")
    return l.race_feature_set(spark.read.parquet(path).drop("batch_id", "run"), spans=False)
