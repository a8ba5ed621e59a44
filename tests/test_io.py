import json

import pytest
from pyspark.sql import functions as F

from lapforge import session
from lapforge.operators.marts import race_replay, replay_by_lap
from lapforge.schemas import LIVE_LAPS, RACE_DOCUMENT
from lapforge.sources import readers as rd
from lapforge.sources import writers as wr
from lapforge.streaming import ingest as st


def test_replace_events_is_idempotent(spark, rows, tmp_path):
    path = str(tmp_path / "events")
    schema = "season_year int, round_number int, driver_code string, points double"
    wr.replace_events(spark.createDataFrame([(2024, 1, "VER", 25.0), (2024, 2, "NOR", 25.0)], schema), path)
    again = spark.createDataFrame([(2024, 2, "PIA", 25.0)], schema)
    for _ in range(2):
        wr.replace_events(again, path)
    assert rows(spark.read.parquet(path), "round_number", "driver_code") == [(1, "VER"), (2, "PIA")]


def test_append_keeps_earlier_rows_and_partitions(spark, tmp_path):
    path = str(tmp_path / "laps")
    df = spark.createDataFrame([(2023, "B", 1), (2024, "A", 2)], "season_year int, circuit_name string, lap int")
    wr.append_table(df, path)
    wr.append_table(df, path)
    assert spark.read.parquet(path).count() == 4
    assert sorted(p.name for p in (tmp_path / "laps").iterdir() if p.is_dir()) == ["season_year=2023", "season_year=2024"]


def test_compaction_keeps_the_newest(spark, rows, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "one")], "k string, at int, v string").write.parquet(src)
    for target in (dst, str(tmp_path / "c")):
        wr.compact_dedup(spark, src, target, ["k"], [F.col("at").desc()])
        src = target
        assert rows(spark.read.parquet(target), "v") == [("new",), ("one",)]


def test_race_documents_with_missing_parts(spark, rows, tmp_path):
    docs = [
        {"year": 2024, "round": 13, "circuit_name": "H", "race_winner": "PIA",
         "drivers": {"PIA": {"name": "O P", "team": "McLaren", "race_position": 1, "qualifying_position": 2, "race_points": 25.0, "race_status": "Finished"},
                     "NOR": {"grid_position": 1, "qualifying_position": 3}},
         "sessions": {"Race": {"raw_laps": [{"driver_code": "PIA", "lap_number": 1, "lap_time_seconds": 80.5}]},
                      "Qualifying": {"raw_qualifying": [{"driver_code": "PIA", "position": 2}, {"driver_code": "", "position": 3}]}},
         "weather": {"available": True, "air_temp_avg": 30.0}},
        {"circuit_name": "H", "drivers": {}, "weather": {"available": False}},
    ]
    path = tmp_path / "docs.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    out = rd.flatten_races(spark.read.schema(RACE_DOCUMENT).json(str(path)))
    assert rows(out["race_results"], "driver_code", "grid_position", "finish_position", "points", "status") == [
        ("NOR", 1, None, 0.0, "Unknown"), ("PIA", 2, 1, 25.0, "Finished")]
    assert rows(out["qualifying_results"], "driver_code", "position") == [("PIA", 2)]
    assert rows(out["lap_times"], "session_type", "lap_number") == [("RACE", 1)]
    assert rows(out["weather"], "air_temp_avg", "rainfall") == [(30.0, False)]


def test_json_dimension(spark, rows, tmp_path):
    path = tmp_path / "circuits.json"
    path.write_text(json.dumps({"a_gp": {"official_names": ["A Grand Prix"], "location": {"city": "X", "coordinates": [1.5, 2.5]}}, "b_gp": {"circuit_type": "technical"}}, indent=2))
    dim = rd.read_dimension_json(spark, str(path), "circuit_key")
    assert rows(dim, "circuit_key", "circuit_type") == [("a_gp", None), ("b_gp", "technical")]
    assert dim.filter("circuit_key = 'a_gp'").select("location.coordinates").collect()[0][0] == [1.5, 2.5]


def test_stream_equals_batch_and_repeats_are_dropped(spark, rows, tmp_path):
    laps = [{"year": 2024, "round": 1, "driver_code": d, "lap_number": n, "lap_time_seconds": 80.0 + n} for d in ("VER", "NOR") for n in range(1, 6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps(m) for m in laps + laps[:4]] + ["{broken"]))
    stream = st.decode(st.read_lap_stream(spark, "text", path=str(tmp_path / "in")), LIVE_LAPS)
    stamped = st.stamp_published(stream, F.lit("2024-01-01").cast("timestamp"))
    unique = st.dedup_stream(stamped, ["year", "round", "driver_code", "lap_number"], "published_at")
    query = st.microbatch(unique, str(tmp_path / "out"), str(tmp_path / "state"), seconds=None)
    assert st.drain(query, 60)
    sink = spark.read.parquet(str(tmp_path / "out"))
    assert rows(sink, "driver_code", "lap_number") == sorted((m["driver_code"], m["lap_number"]) for m in laps)
    expected = spark.createDataFrame([(2024, 1)] * 10, "year int, round int")
    check = st.reconcile(spark, str(tmp_path / "out"), expected, ["year", "round"]).collect()[0]
    assert (check.complete, check.loaded_rows, check.laps, check.drivers) == (True, 10, 5, 2)


def test_replay_comes_in_order(spark, tmp_path):
    df = spark.createDataFrame([(n, d) for n in range(1, 31) for d in "ab"], "lap_number int, driver_code string")
    stream = st.replay(df, str(tmp_path / "replay"), rows_per_slice=12)
    assert st.drain(st.microbatch(stream, str(tmp_path / "out"), str(tmp_path / "state"), seconds=None), 60)
    spans = spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id").agg(F.min("lap_number").alias("lo"), F.max("lap_number").alias("hi")).orderBy("batch_id").collect()
    assert len(spans) > 1 and all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))


def test_a_second_run_appends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for run, rows in enumerate((5, 3)):
        (tmp_path / "in" / f"{run}.json").write_text("\n".join(json.dumps({"year": 2024, "round": run, "driver_code": "VER", "lap_number": n}) for n in range(rows)))
        stream = st.decode(st.read_lap_stream(spark, "text", path=str(tmp_path / "in"), pathGlobFilter=f"{run}.json"), LIVE_LAPS)
        assert st.drain(st.microbatch(stream, str(tmp_path / "out"), str(tmp_path / f"state{run}"), seconds=None), 60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_race_replay_nested(spark):
    laps = spark.createDataFrame(
        [(2023, "C", "RACE", n, p, d, 80.0 + p) for n in range(1, 22) for p, d in ((2, "B"), (1, "A"))] + [(2024, "C", "RACE", 1, 1, "A", 81.0)],
        "season_year int, circuit_name string, session_type string, lap_number int, position int, driver_code string, lap_time_seconds double")
    out = replay_by_lap(race_replay(laps, "C")).orderBy("lap_number").collect()
    assert len(out) == 21 and out[0].season_year == 2023 and out[0].total_laps == 21
    assert [c.driver_code for c in out[0].drivers] == ["A", "B"]
    assert race_replay(laps, "nowhere").count() == 0


def test_query_log(spark):
    log = spark.createDataFrame([("x" * 3000, None), (None, "e")], "response string, error string")
    assert len(wr.log_rows(log).collect()[0].response) == 3000
    out = wr.log_rows(log, response_chars=2000).collect()
    assert (len(out[0].response), out[0].error, out[1].response) == (2000, "", "")


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_a_staged_table_is_not_sent_to_all_tasks(spark):
    """Its packed files look small, whatever the rows; a side that is marked still is sent."""
    session.forget_staged()
    big = session.staged(spark, "test_not_sent", lambda: spark.range(1000).withColumn("x", F.lit("x" * 50)))
    one = spark.range(5)
    for joined in (big.join(one, "id"), one.join(big.groupBy("id").agg(F.max("x").alias("x")), "id")):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert joined.count() == 5
    sent = big.join(F.broadcast(one), "id")
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().sparkPlan().toString()


def test_messages_are_packed_and_whole(spark, tmp_path):
    from lapforge.plans import io_queries as io

    rows = [(i, 7, 3, 1, 10.0, 1000.0, 0.01, 0.02, "N", "O", f"2020-01-{i + 1:02d}") for i in range(20)]
    names = "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate".split()
    items = spark.createDataFrame(rows, [f"l_{n}" for n in names]).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    items.withColumn("l_linenumber", F.col("l_linenumber").cast("int")).write.parquet(str(tmp_path / "lineitem.parquet"))
    path = io.messages(spark, str(tmp_path), copies=3)
    lines = spark.read.text(path)
    assert all(f.endswith(".gz") for f in lines.inputFiles())
    assert lines.filter("value = '{broken'").count() == 3 and st.decode(lines).count() == 60


def test_folders_of_a_table_are_listed_by_few_tasks(spark, tmp_path):
    path, moved, context = str(tmp_path / "laps"), str(tmp_path / "moved"), spark.sparkContext
    rows = spark.range(60).selectExpr("2000 AS season_year", "cast(id AS int) AS round_number", "'C' AS circuit_name", "id")
    wr.append_table(rows, path, ["season_year", "round_number"])
    before = spark.conf.get(session.LISTING)
    context.setJobGroup("listing", "listing")
    try:
        table = rd.read_table(spark, path)
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tasks = sum(context.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds)
    # Two a core, and one for the schema.
    assert 0 < tasks <= 2 * context.defaultParallelism + 1
    assert spark.conf.get(session.LISTING) == before
    assert table.count() == 60 and wr.repartition_table(spark, path, moved, ["round_number"], ["circuit_name"]) == (60, 60)
