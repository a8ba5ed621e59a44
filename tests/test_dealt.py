"""Rows that belong together are dealt once, and what comes out stays the same."""

import datetime
import math
import random

from pyspark.sql import functions as F

from lapforge.operators import asof
from lapforge.operators import history as h
from lapforge.operators import scoring as sc
from lapforge.plans import bindings as b
from lapforge.session import CO_PARTITION, joins_by_some_keys

ITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)
RESULT = "season_year int, round_number int, circuit_name string, driver_code string, team string, grid_position int, finish_position int, points double"


def nodes(node):
    """All operators of a plan before it is run."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.initialPlan()
    children = node.children()
    return [node] + [n for i in range(children.size()) for n in nodes(children.apply(i))]


def shuffles(df, column=None):
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
    names = [[a.name() for a in (n.output().apply(i) for i in range(n.output().size()))] for n in found]
    return len([x for x in names if column is None or column in x])


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9)


def test_results_deal_laps_once(spark, rows, tmp_path):
    rng = random.Random(3)
    items = []
    for n in range(900):
        row = [
            n % 40, rng.choice([1, 2]), rng.choice([None, 1, 2, 103]), rng.choice([None, 1, 2, 7]), float(rng.randint(1, 50)),
            rng.choice([100.5, 900.25]), rng.choice([0.02, 0.05, 0.1, None]), 0.01, "A", "O",
            rng.choice([None, *[datetime.datetime(1998, 4, d) for d in range(1, 26)]]),
        ]
        items += [tuple(row)] * rng.choice([1, 1, 2])
        # Delivered again, and alike up to what does not enter a lap time.
        items.append((*row[:7], 0.03, "R", "F", row[10]))
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = b.lazy_results(spark, str(tmp_path))
    assert shuffles(got) == 1
    sums = b.race_laps(spark, str(tmp_path)).groupBy("season_year", "round_number", "circuit_name", "series", "driver_code", "driver_number").agg(
        F.count("lap_time_seconds").alias("n"), F.sum(F.col("lap_time_seconds").cast("decimal(18,3)")).alias("total"), F.min("lap_time_seconds").alias("best"))
    races = {}
    for r in sums.collect():
        races.setdefault((r.season_year, r.round_number), []).append(r)
    want = []
    for drivers in races.values():
        last = math.inf
        by_finish = sorted(drivers, key=lambda r: (-r.n, last if r.total is None else r.total, r.driver_code or ""))
        by_best = sorted(drivers, key=lambda r: (last if r.best is None else r.best, r.driver_code or ""))
        for r in drivers:
            place = by_finish.index(r) + 1 if r.n >= 12 else None
            want.append((r.season_year, r.round_number, r.circuit_name, r.series, r.driver_code, r.driver_number, by_best.index(r) + 1, place))
    keep = ("season_year", "round_number", "circuit_name", "series", "driver_code", "driver_number", "grid_position", "finish_position")
    assert rows(got, *keep) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert len(want) > 6 and any(r[-1] is None for r in want) and any(r[-1] == 1 for r in want)


def test_dealt_records_are_those_of_before(spark, rows):
    facts = spark.createDataFrame([(None, 1, 5), ("a", 1, 3), ("a", 1, 4), ("a", 4, 10), ("a", None, 99), (None, 3, 7), ("c", 1, None)], "k string, at int, x int")
    probes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 5), ("a", 5), ("a", None), ("b", 9), (None, 4), ("c", 2)], "k string, at int")
    states = {"total": ("sum", F.col("x")), "least": ("min", F.col("x")), "n": ("sum", F.lit(1).cast("long"))}
    columns = ["k", "at", "total", "least", "n"]
    dealt = asof.before(probes, facts, ["k"], states, at="at", by=["k"])
    assert dealt.columns == columns and shuffles(dealt) == 1
    assert rows(dealt, *columns) == rows(asof.before(probes, facts, ["k"], states, at="at"), *columns)
    assert asof.before(probes.limit(0), facts, ["k"], states, at="at", by=["k"]).count() == 0


def season_entries(spark):
    """Every driver in every race; E is a rookie without teammate, F has raced never."""
    mates = {"A": "B", "B": "A", "C": "D", "D": "C", "E": None, "F": "A"}
    data = [
        (year, rnd, f"Ring {rnd}", d, mates[d], d == "E", i + 1, 60.0 - 9 * i, i % 4 + 1, i + 1 if i < 4 else None, 20.0 + 5 * rnd, 20.0 * i, "kept")
        for year in (2020, 2021, 2022, 2023, 2024) for rnd in (1, 2, 3) for i, d in enumerate("ABCDEF")
    ]
    df = spark.createDataFrame(
        data + data[:2],
        "season_year int, round_number int, circuit_name string, driver_code string, teammate string, is_rookie boolean, championship_position int, "
        "championship_points double, team_rank int, grid_position int, temperature double, rain_probability double, note string",
    )
    return df.withColumns({
        "configured_importance": F.lit(0.8), "qualifying_importance": F.lit(0.8), "overtaking_difficulty": F.lit("high"),
        "circuit_type": F.lit("mixed"), "avg_quali_position": F.lit(None).cast("double")})


def test_features_move_the_entries_once(spark):
    known = [
        (year, rnd, f"Ring {rnd}", d, "X", i + 1, None if (d, rnd) == ("D", 3) else (i + year) % 4 + 1, 10.0 - i)
        for year in (2019, 2020, 2021, 2023) for rnd in (1, 2, 3) for i, d in enumerate("ABCD")
    ]
    known = spark.createDataFrame([*known, (None, 1, "Ring 1", "A", "X", 1, 1, 25.0), (2020, 1, None, None, "X", 5, None, 0.0)], RESULT)
    entries = season_entries(spark)
    table = spark.createDataFrame([(y, d, i + 1, 5.0 * i) for y in (2021, 2024) for i, d in enumerate("ABE")], "season_year int, driver_code string, position int, points double")
    rookies = sc.rookie_features(known, table, by=["season_year"])
    condition = F.col("driver_code") == "A"
    args = (condition, condition, condition, condition)
    before = spark.conf.get(CO_PARTITION)
    with joins_by_some_keys(spark):
        got = sc.prediction_features(entries, known, rookies, *args)
        assert shuffles(got, "note") == 1
        got = got.drop("note").collect()
    assert spark.conf.get(CO_PARTITION) == before

    # Step by step, each record found for itself.
    asked = entries.select("season_year", "circuit_name", "driver_code").unionByName(
        entries.select("season_year", "circuit_name", F.col("teammate").alias("driver_code")))
    past = h.features_before(asked, known, ("circuit_name", "driver_code"))
    wins = asof.before(entries, known, ["circuit_name", "driver_code"], {"wins": ("sum", (F.col("finish_position") == 1).cast("long"))})
    want = sc.proxy_history(sc.confidence_before(entries, known), past, rookies, by=("season_year",))
    want = sc.weather_features(sc.qualifying_features(sc.team_momentum(sc.form_score(want))), *args[:2])
    want = want.join(wins, ["season_year", "circuit_name", "driver_code"], "left")
    want = sc.expected_performance(sc.circuit_features(want, *args[2:])).drop("note").collect()

    def keyed(found):
        return sorted(({**r.asDict(), "wins": r.wins or 0} for r in found), key=lambda r: (r["season_year"], r["round_number"], r["driver_code"]))

    assert len(got) == len(want) == 92
    for one, other in zip(keyed(got), keyed(want), strict=True):
        assert one.keys() == other.keys()
        assert all(close(one[c], other[c]) for c in one), (one, other)
    assert len({r.historical_avg_position for r in want}) > 5 and len({r.data_confidence for r in want}) > 3
