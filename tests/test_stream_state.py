"""Flushes, live gaps, late redeliveries and reconciliation by content."""

import random
import time

from pyspark.sql import functions as F

from lapforge.operators import laps as l
from lapforge.session import few_state_partitions
from lapforge.streaming import ingest as st
from lapforge.streaming import stateful as sf

START = 1_700_000_000_000_000  # microseconds


def arrivals(spark, rows):
    df = spark.createDataFrame(rows, "race int, n int, us long")
    return df.select("race", "n", F.timestamp_micros(F.col("us") + START).alias("at"))


def greedy(rows, most, micros):
    """(race, flush) of every n, flushes numbered from 1."""
    out, state = {}, {}
    for race, n, us in sorted(rows, key=lambda r: (r[2], r[1])):
        flush, held, opened = state.get(race, (0, most, 0))
        if held >= most or us - opened >= micros:
            flush, held, opened = flush + 1, 0, us
        state[race] = (flush, held + 1, opened)
        out[race, n] = flush
    return out


def run(spark, stream, tmp_path, name="out", **how):
    assert st.drain(st.microbatch(stream, str(tmp_path / name), str(tmp_path / f"state-{name}"), seconds=None, **how), 120)
    return spark.read.parquet(str(tmp_path / name))


def test_flushes_end_by_rows_or_by_time(spark, tmp_path):
    rng = random.Random(1)
    rows, us = [], 0
    for n in range(600):
        us += rng.choice([1, 1000, 20_000, 20_000, 400_000, 1_999_999, 2_000_000] if n % 100 > 60 else [1000, 2000])
        rows.append((n % 3 if n < 500 else 7, n, us))
    stream = st.replay(arrivals(spark, rows), str(tmp_path / "in"), 90, order=("at", "n"))
    sink = run(spark, sf.cut_flushes(stream, ["race"], "at", rows=20, seconds=2.0), tmp_path)
    assert sink.select("batch_id").distinct().count() > 3 and sink.count() == 600
    numbered = {}
    for r in sink.orderBy("flush").collect():
        numbered.setdefault(r.race, {}).setdefault(r.flush, len(numbered[r.race]) + 1)
    got = {(r.race, r.n): numbered[r.race][r.flush] for r in sink.collect()}
    assert got == greedy(rows, 20, 2_000_000)
    log = sf.flush_log(sink, ["race"], "at", rows=20).collect()
    assert all(r.rows <= 20 and (r.last_arrival - r.first_arrival).total_seconds() < 2 for r in log)
    assert {r.reason for r in log} == {"rows", "seconds", "open"}
    assert all((r.rows == 20) == (r.reason == "rows") for r in log)


def race(rng, year, drivers, laps):
    return [(year, d, n, round(rng.uniform(70, 90), 3)) for d in drivers for n in range(1, laps + 1) if rng.random() < 0.95]


def test_gaps_of_a_stream_in_any_order_equal_the_batch(spark, rows, tmp_path):
    rng = random.Random(2)
    laps = race(rng, 2023, "abcdef", 12) + race(rng, 2024, "abc", 9)
    laps.append((2024, "z", 1, None))
    mixed = [(*r, i) for i, r in enumerate(rng.sample(laps, len(laps)))]
    # The leader of every lap of 2023 comes last of all, and one lap comes twice.
    mixed += [(2023, "lead", n, 60.0, 1000 + n) for n in range(1, 13)] + [(2023, "lead", 3, 60.0, 2000)]
    df = spark.createDataFrame(mixed, "year int, driver_code string, lap_number int, lap_time_seconds double, turn int")
    df = df.withColumn("published_at", F.timestamp_micros(F.lit(START) + F.col("turn") * 1000))
    stream = st.replay(df, str(tmp_path / "in"), 15, order=("turn",))
    sink = run(spark, sf.live_gaps(stream, ["year"]), tmp_path, mode="update")
    key = ["year", "driver_code", "lap_number"]
    latest = sf.latest_gaps(sink, key).select(*key, F.round("gap_to_leader", 6).alias("gap"))
    timed = df.drop("turn", "published_at").dropDuplicates(key).filter("lap_time_seconds IS NOT NULL")
    batch = l.gap_to_leader(timed, ["year", "driver_code"], spans=False).select(*key, F.round("gap_to_leader", 6).alias("gap"))
    assert rows(latest) == rows(batch)
    # A row goes out again only when its gap changed: less than once per batch for each.
    sent = sink.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.round("gap_to_leader", 9)).alias("d")).collect()
    assert all(r.n == r.d or r.n <= r.d + 1 for r in sent) and max(r.n for r in sent) > 1


def test_laps_sent_again_days_later_are_dropped(spark, rows, tmp_path):
    laps = [(2024, r, d, n, day) for day in (1, 9) for r in (1, 2) for d in "ab" for n in range(1, 6)]
    laps += [(2024, 3, "a", n, 9) for n in (1, 2)] + [(2024, 1, "a", 6, 9), (2024, 1, "a", 6, 9), (2024, None, "a", 1, 1), (2024, None, "a", 1, 9)]
    df = spark.createDataFrame(laps, "year int, round int, driver_code string, lap_number int, day int")
    stream = st.replay(df, str(tmp_path / "in"), 8, order=("day", "lap_number"))
    keys = ["year", "round", "driver_code", "lap_number"]
    sink = run(spark, stream, tmp_path, once=keys, event=["year", "round"])
    assert sink.select("batch_id").distinct().count() > 2
    known = {(r.year, r.round, r.driver_code, r.lap_number) for r in sink.filter("round IS NOT NULL").collect()}
    assert known == {x[:4] for x in laps if x[1] is not None} and sink.filter("round IS NOT NULL").count() == len(known)
    # Another run into the same sink, with its own checkpoint, adds nothing either.
    again = st.replay(df.filter("round IS NOT NULL"), str(tmp_path / "again"), 100, order=("day", "lap_number"))
    query = st.microbatch(again, str(tmp_path / "out"), str(tmp_path / "state2"), seconds=None, once=keys, event=["year", "round"])
    assert st.drain(query, 120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("round IS NOT NULL").count() == len(known)


def test_a_repeated_batch_does_not_lose_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(2024, 1, i) for i in range(5)], "year int, round int, lap_number int")
    for _ in range(2):
        st.append_once(df, str(tmp_path / "sink"), 0, "r", ["year", "round", "lap_number"], ["year", "round"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 5
    st.append_once(df, str(tmp_path / "sink"), 1, "r", ["year", "round", "lap_number"], ["year", "round"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 5


def test_only_the_folders_of_the_batchs_events_are_read(spark, tmp_path):
    laps = spark.createDataFrame([(y, r, n) for y in (2023, 2024) for r in range(1, 6) for n in range(3)], "year int, round int, lap_number int")
    keys = ["year", "round", "lap_number"]
    st.append_once(laps, str(tmp_path / "sink"), 0, "r", keys, ["year", "round"])
    held = spark.read.parquet(str(tmp_path / "sink")).filter("(year <=> 2024 AND round <=> 2)")
    assert len(held.inputFiles()) >= 10
    assert "PartitionFilters: [" in held._jdf.queryExecution().toString() and held.count() == 3


def test_a_batch_of_any_number_of_events_is_one_folder_and_loses_no_late_copy(spark, tmp_path):
    laps = spark.range(3000).selectExpr("CAST(2000 + id % 3 AS INT) AS year", "CAST(id AS INT) AS round", "1 AS lap_number")
    keys, event, path = ["year", "round", "lap_number"], ["year", "round"], str(tmp_path / "sink")
    st.append_once(laps, path, 0, "r", keys, event)
    one = spark.createDataFrame([(2000, 0, 1), (2000, 0, 2)], laps.schema)
    st.append_once(one, path, 1, "r", keys, event)
    st.append_once(laps.unionByName(one), path, 2, "r", keys, event)
    sink = spark.read.parquet(path)
    assert sink.count() == 3001 and sink.select(*keys).distinct().count() == 3001
    assert len(sink.filter("batch_id = 0").inputFiles()) < 100


def test_drain_without_a_limit_waits_for_the_end():
    class Query:
        def awaitTermination(self, timeout=None):  # noqa: N802
            return None if timeout is None else False

        def stop(self):
            raise AssertionError("stopped")

    assert st.drain(Query(), None)


def test_replay_uses_as_many_jobs_for_many_slices(spark, tmp_path):
    df = spark.createDataFrame([(n, "a") for n in range(400)], "lap_number int, driver_code string").cache()
    df.count()
    counter = spark.sparkContext.statusTracker()

    def jobs(name, rows):
        spark.sparkContext.setJobGroup(name, name)
        st.replay(df, str(tmp_path / name), rows_per_slice=rows)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(counter.getJobIdsForGroup(name))

    few, many = jobs("few", 200), jobs("many", 10)
    assert few == many
    assert len([p for p in (tmp_path / "many").iterdir() if p.name.startswith("part-")]) > 20


def test_lost_doubled_and_changed_rows_are_seen_where_counts_agree(spark):
    rows = [(2024, r, d, n, 80.0 + n) for r in (1, 2, 3, 4) for d in "ab" for n in range(1, 6)]
    loaded = [r for r in rows if r[:4] not in ((2024, 2, "a", 1), (2024, 4, "a", 1), (2024, 4, "a", 2))]
    loaded += [(2024, 2, "b", 5, 85.0), (2024, 5, "x", 1, None)]
    loaded = [(*r[:4], 99.0) if r[:4] == (2024, 3, "b", 2) else r for r in loaded]
    schema = "year int, round int, driver_code string, lap_number int, lap_time_seconds double"
    got = st.reconcile_content(
        spark.createDataFrame(loaded, schema), spark.createDataFrame(rows, schema), ["year", "round"], ["driver_code", "lap_number"], ["lap_time_seconds"]
    )
    found = {r.round: (r.expected_rows, r.loaded_rows, r.lost_rows, r.doubled_rows, r.changed_rows, r.same) for r in got.collect()}
    assert found == {
        1: (10, 10, 0, 0, 0, True), 2: (10, 10, 1, 1, 0, False), 3: (10, 10, 0, 0, 1, False), 4: (10, 8, 2, 0, 0, False), 5: (0, 1, 0, 1, 0, False),
    }
    empty = spark.createDataFrame([], schema)
    assert st.reconcile_content(empty, empty, ["year", "round"], ["driver_code", "lap_number"], ["lap_time_seconds"]).count() == 0


def test_a_long_replay_takes_whole_slices_together_in_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "TRIGGERS", 4, raising=False)
    df = spark.createDataFrame([(n % 60, f"d{n // 60}") for n in range(180)], "lap_number int, driver_code string")
    sink = run(spark, st.replay(df, str(tmp_path / "in"), rows_per_slice=15), tmp_path)
    batches = sink.groupBy("batch_id").agg(F.min("lap_number").alias("low"), F.max("lap_number").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()
    assert 4 <= len(batches) <= 8 and sum(b.n for b in batches) == sink.distinct().count() == 180
    assert all(a.high <= b.low for a, b in zip(batches, batches[1:], strict=False))
    short = run(spark, st.replay(df, str(tmp_path / "short"), rows_per_slice=45), tmp_path, "few")
    assert short.select("batch_id").distinct().count() == 4


def test_many_keys_share_a_few_states_and_keep_their_own_flushes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(300), n, n * 700 + rng.randrange(300)) for n in range(4000)]
    named = arrivals(spark, rows).withColumn("name", F.concat(F.lit("r, "), F.col("race") % 7))
    named = named.unionByName(named.limit(3).withColumn("name", F.lit(None).cast("string")))
    stream = st.replay(named, str(tmp_path / "in"), 900, order=("at", "n"))
    with few_state_partitions(spark):
        query = st.microbatch(sf.cut_flushes(stream, ["race", "name"], "at", rows=4, seconds=0.2), str(tmp_path / "out"), str(tmp_path / "state"), seconds=None)
    assert st.drain(query, 120)
    state = query.lastProgress.stateOperators[0]
    assert 0 < state.numRowsTotal <= sf.KEY_GROUPS < len({r[0] for r in rows})
    assert state.numShufflePartitions <= spark.sparkContext.defaultParallelism and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    numbered, got = {}, {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("flush").collect():
        of = numbered.setdefault(r.race, {})
        got[r.race, r.n] = of.setdefault(r.flush, len(of) + 1)
    assert got == greedy(rows, 4, 200_000)


def test_an_idle_key_gives_up_its_state_and_goes_on_from_its_arrival(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: arrivals(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    put([(1, 1, 0), (1, 2, 10), (2, 3, 20)])
    stream = spark.readStream.schema(arrivals(spark, []).schema).parquet(folder)
    query = st.microbatch(sf.cut_flushes(stream, ["race"], "at", idle="2 seconds"), out, str(tmp_path / "state"), seconds=0.2)

    def until(done):
        end = time.time() + 60
        while not done():
            assert time.time() < end and query.isActive
            time.sleep(0.2)

    def sent():
        return [tuple(r) for r in spark.read.schema("n int, flush long").parquet(out).select("n", "flush").orderBy("n").collect()] if (tmp_path / "out").exists() else []

    try:
        until(lambda: len(sent()) == 3)
        until(lambda: query.lastProgress and query.lastProgress.stateOperators[0].numRowsTotal == 0)
        put([(1, 4, 500), (2, 5, 510)])
        until(lambda: len(sent()) == 5)
    finally:
        query.stop()
    assert sent() == [(1, START), (2, START), (3, START + 20), (4, START + 500), (5, START + 510)]


def test_races_share_a_few_states_and_null_races_and_laps_keep_their_gaps(spark, rows, tmp_path):
    rng = random.Random(4)
    laps = [(y, d, n, round(rng.uniform(70, 90), 3), rng.randrange(9000)) for y in range(150) for d in "abc" for n in (1, 2, 3)]
    laps += [(None, d, n, 80.0 + n, rng.randrange(9000)) for d in "ab" for n in (1, 2)] + [(2**62 + 1, "a", 1, 81.0, 5), (2**62 + 2, "a", 1, 82.0, 6)]
    df = spark.createDataFrame(laps, "year long, driver_code string, lap_number int, lap_time_seconds double, turn int")
    df = df.withColumn("published_at", F.timestamp_micros(F.lit(START) + F.col("turn") * 1000))
    late = df.filter("year = 3 AND lap_number = 3 AND driver_code = 'a'").withColumns({"lap_number": F.lit(None).cast("int"), "turn": F.lit(9500)})
    stream = st.replay(df.unionByName(late), str(tmp_path / "in"), 400, order=("turn",))
    query = st.microbatch(sf.live_gaps(stream, ["year"]), str(tmp_path / "out"), str(tmp_path / "state"), seconds=None, mode="update")
    assert st.drain(query, 120)
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= sf.KEY_GROUPS
    sink, key = spark.read.parquet(str(tmp_path / "out")), ["year", "driver_code", "lap_number"]
    assert sink.schema["year"].dataType.simpleString() == "bigint" and sink.filter("lap_number IS NULL").count() == 1
    latest = sf.latest_gaps(sink.filter("lap_number IS NOT NULL"), key)
    assert "SortAggregate" not in latest._jdf.queryExecution().executedPlan().toString()
    total = {}
    for y, d, n, t, _ in sorted(laps, key=lambda r: (str(r[0]), r[1], r[2])):
        total[y, d, n] = total.get((y, d, n - 1), 0) + t
    wanted = sorted(((y, d, n), round(t - min(total[y, e, n] for e in "abc" if (y, e, n) in total), 6) + 0.0) for (y, d, n), t in total.items() if y is not None)
    got = {(r.year, r.driver_code, r.lap_number): round(r.gap_to_leader, 6) + 0.0 for r in latest.collect()}
    assert sorted((k, v) for k, v in got.items() if k[0] is not None) == wanted
    assert {k[1:]: v for k, v in got.items() if k[0] is None} == {("a", 1): 0.0, ("b", 1): 0.0, ("a", 2): 0.0, ("b", 2): 0.0}


def test_files_of_the_sink_beyond_the_keys_of_a_batch_are_not_read(spark, tmp_path):
    path, keys, event = tmp_path / "sink", ["round", "lap_number"], ["round"]
    laps = lambda lap: spark.range(100).selectExpr("CAST(id AS INT) AS round", f"{lap} AS lap_number").coalesce(1)
    st.append_once(laps(1), str(path), 0, "r", keys, event)
    st.append_once(laps(5), str(path), 1, "r", keys, event)
    for part in (path / "run=r" / "batch_id=0").rglob("part-*.parquet"):
        # Spoil the rows, not the footer: whoever reads them fails.
        part.write_bytes(part.read_bytes()[:4] + bytes(60) + part.read_bytes()[64:])
        (part.parent / f".{part.name}.crc").unlink()
    st.append_once(laps(5).union(laps(6)), str(path), 2, "r", keys, event)
    held = spark.read.parquet(str(path)).filter("batch_id > 0")
    assert held.count() == 200 and held.select(*keys).distinct().count() == 200
