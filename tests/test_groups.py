"""Ranks and quantiles of groups that most rows share."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lapforge.operators import groups as g
from lapforge.sources import writers as wr


def test_shared_ranks_with_most_values_equal(spark):
    rng = random.Random(3)
    data = [("a", 5.0)] * 900 + [("a", rng.uniform(0, 10)) for _ in range(100)] + [("b", float(i % 4)) for i in range(40)] + [("a", None), (None, 1.0), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, x double").repartition(6)
    for descending in (False, True):
        for how in ({}, {"step": 0.5}, {"parts": 2}):
            got = g.with_rank(df, ["k"], "x", "r", descending=descending, **how).collect()
            assert len(got) == len(data)
            for row in got:
                sign = -1 if descending else 1
                less = sum(k == row.k and x is not None and sign * x < sign * row.x for k, x in data) if row.x is not None else None
                assert row.r == (None if less is None else less + 1)


def test_equal_values_meet_once_not_row_by_row(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(7.0).alias("x"))
    plan = g.with_rank(df, ["k"], "x", "r")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in f" {line.strip(' :+-')} "]
    # No window runs over rows: all are over counts of different values or of stretches.
    assert windows and all("__n" in w or "__held" in w for w in windows)


def exact(values, share):
    ordered = sorted(values)
    for i, v in enumerate(ordered, 1):
        if i * 10_000 >= round(share * 10_000) * len(ordered):
            return v
    return None


def test_quantiles_of_a_huge_group_and_of_small_ones(spark):
    rng = random.Random(4)
    data = [("big", rng.gauss(0, 1)) for _ in range(5000)] + [("same", 2.0)] * 300 + [("one", 1.0), (None, 4.0), (None, 5.0), ("none", None)]
    data += [("mixed", float(rng.choice([1, 1, 1, 9]))) for _ in range(101)]
    df = spark.createDataFrame(data, "k string, x double").repartition(5)
    shares = {"q0": "0", "q05": "0.05", "q5": "0.5", "q95": "0.95", "q99": "0.99", "q1": "1"}
    for parts in (64, 2):
        got = {r.k: r.asDict() for r in g.group_quantiles(df, ["k"], "x", shares, parts).collect()}
        assert set(got) == {"big", "same", "one", None, "mixed"}
        for key, row in got.items():
            values = [x for k, x in data if k == key]
            for name, share in shares.items():
                assert row[name] == exact(values, float(share)), (key, name)


def test_query_log_statistics_keep_missing_models_and_times(spark):
    log = spark.createDataFrame(
        [("m", 1.0, True), ("m", 2.0, False), ("m", 3.0, True), (None, 9.0, True), ("x", None, True)], "model_used string, latency_ms double, success boolean"
    ).withColumns({"timestamp": F.lit("2024-01-01").cast("timestamp"), "estimated_bytes": F.lit(10).cast("long")})
    got = {r.model_used: (r.queries, r.latency_p50, r.latency_p95) for r in wr.query_log_stats(log).collect()}
    assert got == {"m": (3, 2.0, 3.0), None: (1, 9.0, 9.0), "x": (1, None, None)}


def test_a_hot_value_is_split_by_adaptive_execution(spark):
    counts = Counter()
    df = spark.range(3000).select(F.lit("a").alias("k"), F.lit(7.0).alias("x"), "id")
    for row in g.with_rank(df, ["k"], "x", "r").collect():
        counts[row.r] += 1
    assert counts == {1: 3000}


def test_texts_cut_into_grams_are_not_sent_whole(spark):
    """Their number is not known before they are cut, so no side of the gram joins may be broadcast."""
    texts = spark.createDataFrame([(i, f"the spa road {i}") for i in range(50)] + [(50, "ab"), (51, None)], "id int, text string")
    names = spark.createDataFrame([("spa",), ("road 7",), ("b",), ("zzz",)], "name string")
    held = g.held_join(texts, names, "text", "name")
    both = g.contains_join(texts, names, "text", "name")
    for df in (held, both):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    expected = {(i, "spa") for i in range(50)} | {(7, "road 7"), (50, "b")}
    assert {(r["id"], r["name"]) for r in held.collect()} == {(r["id"], r["name"]) for r in both.collect()} == expected
