import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lapforge.operators import groups as g
from lapforge.operators import laps as l

SCHEMA = (
    "season_year int, round_number int, session_type string, driver_code string, circuit_name string, lap_number int, "
    "lap_time_seconds double, sector1_seconds double, sector2_seconds double, sector3_seconds double, compound string, "
    "tyre_life int, stint int"
)


def make_laps(spark, n_hot=60, seed=3):
    """One driver with a third of all laps, gaps in lap numbers, stints that differ in length."""
    rng = random.Random(seed)
    data = []
    for driver, n in [("HOT", n_hot)] + [(f"D{i}", 20) for i in range(6)]:
        for lap in sorted(rng.sample(range(1, n * 2), n)):
            t = rng.uniform(80, 95) if rng.random() > 0.1 else None
            data.append(
                (2024, 1, "RACE", driver, "Circuit", lap, t, rng.uniform(20, 30), rng.uniform(20, 30), rng.uniform(20, 30),
                 rng.choice(["SOFT", "HARD", "nan", ""]), lap % 9, None if driver == "D5" else lap // 25)
            )
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(g, "LAP_BLOCK", 7)


def same(a, b, rows, *columns):
    left, right = rows(a, *columns), rows(b, *columns)
    assert len(left) == len(right) > 0
    for x, y in zip(left, right):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (x, y)


KEY = ["driver_code", "lap_number"]


@pytest.mark.parametrize(
    "operator, column",
    [
        (l.lap_delta, "lap_delta"),
        (l.rolling_delta, "rolling_delta_3"),
        (l.stint_index, "stint_lap_index"),
        (l.rolling_consistency, "rolling_stddev_5"),
        (l.sector_deltas, "s2_delta"),
        (l.wear_fraction, "wear_fraction"),
        (l.gap_to_leader, "gap_to_leader"),
        (l.filter_outliers, "lap_time_seconds"),
    ],
)
def test_blocked_equals_plain(spark, rows, small_blocks, operator, column):
    laps = make_laps(spark)
    same(operator(laps, spans=True), operator(laps, spans=False), rows, *KEY, column)


def test_median_is_exact_in_a_large_group(spark):
    """More distinct times than a sketch holds, in one stint."""
    times = spark.range(30_001).selectExpr("2024 AS season_year", "id AS lap_number", "100 + id * 0.001 AS lap_time_seconds")
    for spans in (True, False):
        kept = l.filter_outliers(times, ["season_year"], factor=1.0, spans=spans)
        assert kept.count() == 15_001


@pytest.mark.parametrize("spread", [1.0, 1e300])
def test_median_of_a_blocked_group_holds_no_values_together(spark, spread):
    rng = random.Random(4)
    data = [(g, lap, rng.choice([1.0, spread]) * rng.choice([rng.random(), 0.5]) - 0.2) for g, n in (("a", 30_001), ("b", 2000), ("c", 1), ("d", 2)) for lap in range(n)]
    df = g.blocked(spark.createDataFrame([*data, ("e", 1, 7.0), ("e", 90_000, 8.0), ("e", 3, 7.0), ("f", None, 1.0), ("f", None, 1.0), ("f", 5000, 3.0)], "k string, lap_number int, v double"))
    out = g.with_median(df, ["k"], "v", "m", g.BLOCK)
    assert "percentile_disc" not in out._jdf.queryExecution().toString().lower()
    got = {r.k: (r.m, r.n) for r in out.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = {k: [v for a, _, v in data if a == k] for k in "abcd"} | {"e": [7.0, 8.0, 7.0]}
    assert got.pop("f") in ((1.0, 1), (None, 2)) and {r.m for r in out.filter("k = 'f' AND lap_number = 5000").collect()} == {1.0}
    assert got == {k: (statistics.median_low(v), len(v)) for k, v in groups.items()}
    filtered = l.filter_outliers(spark.createDataFrame([(1, 1, 1.0)], "k int, lap_number int, v double"), ["k"], "v")
    assert "percentile_disc" not in filtered._jdf.queryExecution().toString().lower()


def test_feature_set_is_the_same_in_blocks(spark, rows, small_blocks):
    laps = make_laps(spark)
    blocked = l.driver_race_features(l.lap_features(laps, spans=True))
    plain = l.driver_race_features(l.lap_features(laps, spans=False))
    same(blocked, plain, rows)


def test_rolling_windows_match_brute_force(spark):
    laps = make_laps(spark).filter("lap_time_seconds IS NOT NULL")
    out = l.rolling_consistency(laps).filter("driver_code = 'HOT'").orderBy("lap_number").collect()
    times = [r.lap_time_seconds for r in out]
    for i, r in enumerate(out):
        near = times[max(0, i - 2) : i + 3]
        assert math.isclose(r.rolling_stddev_5, statistics.stdev(near), rel_tol=1e-9)
        assert math.isclose(r.consistency_score, 1 / (1 + statistics.stdev(near)), rel_tol=1e-9)


def test_median_filter_uses_the_lower_median_and_includes_the_limit(spark, rows):
    data = [(2024, 1, "RACE", "VER", "C", i + 1, t, None, None, None, "SOFT", 1, 1) for i, t in enumerate([100.0, 110.00000000000001, 111.0, 90.0])]
    kept = l.filter_outliers(spark.createDataFrame(data, SCHEMA))
    assert rows(kept, "lap_number") == [(1,), (2,), (4,)]


def test_compound_nulls(spark, rows):
    df = spark.createDataFrame([("SOFT",), ("nan",), ("None",), ("",), ("Hard",), (None,)], "compound string")
    got = {r.compound: r.clean_compound for r in l.clean_compound(df).collect()}
    assert got == {"SOFT": "SOFT", "nan": None, "None": None, "": None, "Hard": "Hard", None: None}


def test_starting_compound_skips_missing(spark):
    data = [(2024, 1, "RACE", "VER", "C", i, 90.0, 1.0, 1.0, 1.0, c, 1, 1) for i, c in [(1, "nan"), (2, "HARD"), (3, "SOFT")]]
    out = l.race_feature_set(spark.createDataFrame(data, SCHEMA)).collect()[0]
    assert (out.starting_compound, out.num_compounds, out.total_laps) == ("HARD", 2, 3)


def test_consistency_edge_cases(spark, rows):
    data = [(2024, 1, "RACE", d, "C", i, t, None, None, None, "SOFT", 1, 1)
            for d, i, t in [("ONE", 1, 90.0), ("FAR", 1, 90.0), ("FAR", 2, 200.0), ("EVEN", 1, 90.0), ("EVEN", 2, 90.0)]]
    out = dict(rows(l.lap_consistency(spark.createDataFrame(data, SCHEMA)), "driver_code", "consistency"))
    assert out == {"ONE": 1.0, "FAR": 0.5, "EVEN": 1.0}


@pytest.mark.parametrize("step", [None, 0.5])
@pytest.mark.parametrize("descending", [False, True])
def test_rank_matches_window(spark, rows, step, descending):
    rng = random.Random(5)
    data = [(rng.choice("ab"), f"k{i}", rng.choice([None, 1.0, 1.5, 2.25, rng.uniform(0, 50)])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, k string, v double")
    order = "DESC" if descending else "ASC"
    df.createOrReplaceTempView("ranked_input")
    want = spark.sql(f"SELECT g, k, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY g ORDER BY v {order} NULLS LAST) END AS r FROM ranked_input")
    assert rows(g.with_rank(df, ["g"], "v", "r", descending, step=step), "g", "k", "r") == rows(want)
    want = spark.sql(f"SELECT g, k, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY g ORDER BY v {order} NULLS LAST, k) END AS r FROM ranked_input")
    assert rows(g.with_rank(df, ["g"], "v", "r", descending, "k", step), "g", "k", "r") == rows(want)


def test_contains_join_matches_brute_force(spark, rows):
    rng = random.Random(9)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    left, right = sorted(set(words[:30])), sorted(set(words[30:]))
    got = g.contains_join(
        spark.createDataFrame([(w,) for w in left], "x string"), spark.createDataFrame([(w,) for w in right], "y string"), "x", "y"
    )
    assert rows(got, "x", "y") == sorted((a, b) for a in left for b in right if a in b or b in a)


def test_plans_have_no_python_and_limit_before_the_shuffle(spark):
    laps = make_laps(spark)
    plan = l.race_feature_set(laps, spans=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    newest = g.top_n(laps, KEY, [F.col("stint").desc()], 1)
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()


def odd_laps(spark):
    """Ties, missing times, stints and keys, two sessions of a race."""
    data = []
    for driver in ("AAA", "BBB", "CCC", None):
        for lap in range(1, 12):
            time = None if lap == 4 and driver == "BBB" else 70.0 + (lap * 7 + len(driver or "") * 3) % 5 + (60 if lap == 6 else 0)
            stint = None if driver == "CCC" else 1 + lap // 6
            season = None if lap == 9 else 2020
            for session in ("RACE", "FP1"):
                data.append((season, 1, "Circuit 1", session, driver, lap, time, 20.0 + lap, 30.0, None, "SOFT" if lap % 2 else "nan", stint))
    schema = (
        "season_year int, round_number int, circuit_name string, session_type string, driver_code string, lap_number int, "
        "lap_time_seconds double, sector1_seconds double, sector2_seconds double, sector3_seconds double, compound string, stint int"
    )
    # A lap without a season has no other lap beside it, as staging leaves them.
    return spark.createDataFrame(data, schema)


def test_small_groups_give_the_rows_of_large_ones(spark, rows):
    laps = odd_laps(spark)
    ranked = [rows(l.lap_rank(laps, spans=spans), *laps.columns, "lap_rank") for spans in (False, True)]
    assert ranked[0] == ranked[1] and any(r[-1] is None for r in ranked[0])
    steady = [
        rows(l.lap_consistency(laps, spans=spans).withColumn("consistency", F.round("consistency", 9))) for spans in (False, True)
    ]
    assert steady[0] == steady[1]


def test_small_groups_are_read_once_and_never_joined(spark):
    laps = odd_laps(spark)
    for out in (l.lap_rank(laps, spans=False), l.lap_consistency(laps, spans=False)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") == 1


def test_small_feature_set_shuffles_laps_once(spark, rows):
    laps = odd_laps(spark)
    plain = l.race_feature_set(laps, spans=False)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Expand" not in plan
    assert plain.filter("season_year IS NULL OR driver_code IS NULL").count() == 5
    known = laps.filter("season_year IS NOT NULL AND driver_code IS NOT NULL")
    same(l.race_feature_set(known, spans=True), l.race_feature_set(known, spans=False), rows)


def test_feature_queries_write_no_laps(spark, tmp_path, monkeypatch):
    from lapforge.plans import all_queries, bindings

    lines = [(o, 7, o % 3, 1 + o % 7, 10.0, 100.0 * o, 0.05, 0.01, "N", "O", datetime.datetime(2000, 1, 1 + o % 28)) for o in range(40)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(bindings, "staged", lambda *_: pytest.fail("laps are written"))
    for name in ("W09_race_feature_set", "A01_driver_race_features"):
        assert all_queries()[name](spark, str(tmp_path)).count() == 3
