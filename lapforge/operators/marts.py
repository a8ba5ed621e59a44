"""Marts and serving queries over results and laps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.cleaning import distinct_names, exclude_aliases, race_laps
from lapforge.operators.groups import attach, top_n
from lapforge.operators.laps import TIME

MIN_STINT_LAPS = 8
MIN_REPLAY_LAPS = 20


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return part / F.nullif(whole, F.lit(0))


def consistency(deviation: Column) -> Column:
    """1 for no spread, towards 0 as it grows."""
    return 1.0 / (1.0 + F.coalesce(deviation, F.lit(0.0)))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def decay(season: Column, latest: Column, half_life: float) -> Column:
    """Weight that halves every `half_life` seasons before the latest one."""
    return F.pow(F.lit(0.5), (latest - season) / F.lit(half_life))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over rows where the value is known, NULL for no weight."""
    known = F.when(value.isNotNull(), weight)
    return F.sum(value * weight) / F.nullif(F.sum(known), F.lit(0.0))


def with_weight(
    df: DataFrame, seed: DataFrame, key: str = "circuit_name",
    col: str = "regulation_similarity_weight", default: float = 1.0,
) -> DataFrame:
    """Join the seed weight; circuits without one get `default` and `weight_matched` false."""
    known = seed.select(key, F.col(col).alias("__w"))
    return (
        df.join(known, key, "left")
        .withColumn("weight_matched", F.col("__w").isNotNull())
        .withColumn(col, F.coalesce(F.col("__w"), F.lit(default)))
        .drop("__w")
    )


def driver_circuit_performance(
    results: DataFrame,
    weights: DataFrame | None = None,
    half_life: float = 2.0,
    weight_col: str = "regulation_similarity_weight",
) -> DataFrame:
    """One row per driver and circuit; with `weights`, weighted means as extra columns.

    The weight of a race is its recency decay times the circuit's similarity weight.
    """
    finish, grid = F.col("finish_position"), F.col("grid_position")
    n = F.count(F.lit(1))
    columns = [
        n.alias("races_at_circuit"),
        F.avg(finish).alias("avg_finish"),
        F.min(finish).alias("best_finish"),
        F.avg(grid).alias("avg_grid"),
        F.sum("points").alias("total_points"),
        count_where(finish == 1).alias("wins"),
        count_where(finish <= 3).alias("podiums"),
        count_where(finish <= 10).alias("points_finishes"),
        count_where(finish.isNull()).alias("dnfs"),
        F.avg(grid - finish).alias("avg_positions_gained"),
        consistency(F.stddev_samp(finish)).alias("consistency_score"),
        (count_where(finish == 1) / n).alias("win_rate"),
        (count_where(finish <= 3) / n).alias("podium_rate"),
        (count_where(finish.isNull()) / n).alias("dnf_rate"),
    ]
    if weights is not None:
        latest = results.agg(F.max("season_year")).scalar()
        results = with_weight(results, weights, col=weight_col)
        weight = decay(F.col("season_year"), latest, half_life) * F.col(weight_col)
        columns += [
            weighted_mean(finish, weight).alias("weighted_avg_finish"),
            weighted_mean(grid - finish, weight).alias("weighted_positions_gained"),
            weighted_mean(F.col("points"), weight).alias("weighted_points"),
        ]
    return results.groupBy("driver_code", "circuit_name").agg(*columns)


def last_n(
    df: DataFrame, keys: Sequence[str] = ("driver_code",),
    order: Sequence[str] = ("season_year", "round_number"), n: int = 5,
) -> DataFrame:
    """The last `n` races of each driver."""
    return top_n(df, keys, [F.col(c).desc() for c in order], n)


def driver_form_last5(results: DataFrame, n: int = 5) -> DataFrame:
    """Form of each driver over the last five races."""
    finish, grid = F.col("finish_position"), F.col("grid_position")
    return last_n(results, n=n).groupBy("driver_code").agg(
        F.count(F.lit(1)).alias("races_counted"),
        F.avg(finish).alias("avg_finish_last5"),
        F.min(finish).alias("best_finish_last5"),
        F.sum("points").alias("total_points_last5"),
        F.stddev_samp(finish).alias("finish_stddev_last5"),
        consistency(F.stddev_samp(finish)).alias("consistency_score_last5"),
        F.avg(grid - finish).alias("avg_positions_gained_last5"),
        count_where(finish <= 3).alias("podiums_last5"),
        count_where(finish <= 10).alias("points_finishes_last5"),
    )


def tire_degradation(laps: DataFrame, pooled: bool = False) -> DataFrame:
    """Slope of lap time over tyre age per circuit, driver and compound.

    Slopes are fitted inside each stint and averaged with the stint's laps as weight;
    stints too short for a slope carry no weight. `pooled` fits one line through all.
    """
    keys = ["circuit_name", "driver_code", "compound"]
    timed = race_laps(laps)
    slope = F.regr_slope(F.col(TIME), F.col("tyre_life").cast("double"))
    if pooled:
        return timed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_laps"),
            slope.alias("deg_seconds_per_lap"),
            F.avg(TIME).alias("avg_lap_time"),
            F.min(TIME).alias("fastest_lap"),
        )
    stints = timed.groupBy(*keys, "season_year", "round_number", "stint").agg(
        F.count(F.lit(1)).alias("__n"),
        slope.alias("__slope"),
        F.sum(TIME).alias("__sum"),
        F.min(TIME).alias("__min"),
    )
    return stints.groupBy(*keys).agg(
        F.sum("__n").alias("n_laps"),
        weighted_mean(F.col("__slope"), F.col("__n").cast("double")).alias("deg_seconds_per_lap"),
        (F.sum("__sum") / F.sum("__n")).alias("avg_lap_time"),
        F.min("__min").alias("fastest_lap"),
    )


def compound_degradation(
    mart: DataFrame, circuit: str | None = None, min_laps: int = MIN_STINT_LAPS
) -> DataFrame:
    """Average degradation per compound, from rows with enough laps."""
    kept = mart.filter(F.col("n_laps") >= min_laps)
    if circuit is not None:
        kept = kept.filter(F.col("circuit_name") == circuit)
    return (
        kept.groupBy("circuit_name", "compound")
        .agg(
            F.round(F.avg("deg_seconds_per_lap"), 4).alias("avg_degradation_per_lap"),
            F.count_distinct("driver_code").alias("driver_count"),
            F.round(F.avg("n_laps"), 1).alias("avg_stint_length"),
        )
        .orderBy("circuit_name", "compound")
    )


def driver_totals(mart: DataFrame, driver: str | None = None) -> DataFrame:
    """Career totals over all circuits, legacy names left out."""
    kept = exclude_aliases(mart, "circuit_name")
    if driver is not None:
        kept = kept.filter(F.col("driver_code") == driver.upper())
    return kept.groupBy("driver_code").agg(
        F.sum("races_at_circuit").alias("total_races"),
        F.sum("wins").alias("total_wins"),
        F.sum("podiums").alias("total_podiums"),
    )


def platform_stats(results: DataFrame, laps: DataFrame, mart: DataFrame) -> DataFrame:
    """One row: circuits after alias normalization, season range, entry and lap counts."""
    circuits = distinct_names(mart, "circuit_name").agg(F.count(F.lit(1))).scalar()
    counted = exclude_aliases(laps, "circuit_name").agg(F.count(F.lit(1))).scalar()
    entries = exclude_aliases(results, "circuit_name").agg(
        F.min("season_year").alias("first_season"),
        F.max("season_year").alias("last_season"),
        F.count(F.lit(1)).alias("total_race_entries"),
    )
    return entries.withColumns({"circuits_ingested": circuits, "total_laps_processed": counted})


def load_check(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct laps and drivers per event against the expected row count."""
    found = actual.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loaded_rows"),
        F.count_distinct("lap_number").alias("laps"),
        F.count_distinct("driver_code").alias("drivers"),
    )
    wanted = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected_rows"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("loaded_rows", "laps", "drivers", "expected_rows")}
    return (
        wanted.join(found, list(keys), "full")
        .withColumns(zero)
        .withColumn("complete", F.col("loaded_rows") == F.col("expected_rows"))
    )


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_drivers(mart: DataFrame, circuit: str, n: int = 5) -> DataFrame:
    """Drivers with the best average finish at a circuit; a driver never classified has none."""
    return (
        mart.filter((F.col("circuit_name") == circuit) & F.col("avg_finish").isNotNull())
        .orderBy("avg_finish", "driver_code")
        .limit(n)
        .select("driver_code", "races_at_circuit", "avg_finish", "wins", "podiums")
    )


def longest_stint_key(laps: DataFrame, circuit: str, compound: str) -> DataFrame:
    """The key of the stint with most timed laps; ties go to the latest, then by driver."""
    keys = ["season_year", "round_number", "driver_code", "stint"]
    timed = race_laps(laps).filter(
        (F.col("circuit_name") == circuit) & (F.col("compound") == compound.upper())
    )
    order = [F.col("count").desc(), F.col("season_year").desc(), "driver_code", F.col("round_number").desc(), "stint"]
    return timed.groupBy(*keys).count().orderBy(*order).limit(1)


def longest_stint(laps: DataFrame, circuit: str, compound: str) -> DataFrame:
    """The laps of the single longest race stint on a compound."""
    keys = ["season_year", "round_number", "driver_code", "stint"]
    timed = race_laps(laps).filter(
        (F.col("circuit_name") == circuit) & (F.col("compound") == compound.upper())
    )
    # One row, so broadcasting is safe.
    chosen = F.broadcast(longest_stint_key(laps, circuit, compound).select(*keys))
    return (
        timed.join(chosen, keys)
        .select("driver_code", "lap_number", "tyre_life", F.round(TIME, 3).alias(TIME))
        .orderBy("lap_number")
    )


def latest_full_season(laps: DataFrame, circuit: str, min_laps: int = MIN_REPLAY_LAPS) -> DataFrame:
    """The latest season whose race has at least `min_laps` distinct laps, or no row."""
    race = laps.filter((F.col("circuit_name") == circuit) & (F.col("session_type") == "RACE"))
    return (
        race.groupBy("season_year")
        .agg(F.count_distinct("lap_number").alias("distinct_laps"))
        .filter(F.col("distinct_laps") >= min_laps)
        .orderBy(F.col("season_year").desc())
        .limit(1)
    )


def race_replay(laps: DataFrame, circuit: str, min_laps: int = MIN_REPLAY_LAPS) -> DataFrame:
    """The latest full race, lap by lap in running order; `total_laps` is the race distance."""
    season = F.broadcast(latest_full_season(laps, circuit, min_laps).select("season_year"))
    race = laps.filter((F.col("circuit_name") == circuit) & (F.col("session_type") == "RACE"))
    race = race.join(season, "season_year")
    distance = race.agg(F.max("lap_number")).scalar()
    return (
        race.select(
            "season_year", distance.alias("total_laps"), "lap_number", "position", "driver_code",
            F.round(TIME, 3).alias(TIME),
        )
        .orderBy("lap_number", "position", "driver_code")
    )


def replay_by_lap(replay: DataFrame) -> DataFrame:
    """Nest a replay: one row per lap with its cars in running order (for one race's output)."""
    car = F.struct("position", "driver_code", TIME)
    return replay.groupBy("season_year", "total_laps", "lap_number").agg(
        F.array_sort(F.collect_list(car)).alias("drivers")
    )


def leaderboard(laps: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` cars of every lap."""
    keys = ["season_year", "round_number", "session_type", "lap_number"]
    return top_n(laps, keys, [F.col("position"), F.col("driver_code")], n, "place")


def degradation_sample(mart: DataFrame, pattern: str, n: int = 15) -> DataFrame:
    """First rows by compound and falling slope for circuits matching a pattern."""
    return (
        mart.filter(F.contains(F.lower("circuit_name"), F.lit(pattern.lower())))
        .orderBy("compound", F.col("deg_seconds_per_lap").desc_nulls_last(), "circuit_name", "driver_code")
        .limit(n)
        .select("circuit_name", "driver_code", "compound", "n_laps", "deg_seconds_per_lap")
    )


def default_compound(df: DataFrame, keys: Sequence[str] = ("circuit_name",)) -> DataFrame:
    """MEDIUM where available, else the first of SOFT and HARD."""
    choice = F.when(F.col("compound") == "MEDIUM", 0).when(F.col("compound") == "SOFT", 1)
    choice = choice.when(F.col("compound") == "HARD", 2)
    ranked = df.withColumn("__p", choice).groupBy(*keys).agg(F.min("__p").alias("__p"))
    name = F.element_at(F.array(F.lit("MEDIUM"), F.lit("SOFT"), F.lit("HARD")), F.col("__p") + 1)
    return ranked.filter(F.col("__p").isNotNull()).select(*keys, name.alias("compound"))


def normalize(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Scale `col` so it sums to 1 in each group."""
    out = attach(df, keys, {"__sum": F.sum(col)})
    share = F.when(F.col("__sum") > 0, F.col(col) / F.col("__sum")).otherwise(F.col(col))
    return out.withColumn(name or col, share).drop("__sum")


def top_margin(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """The best value of each group, and its lead over the second best (or over zero)."""
    first = top_n(df, keys, [F.col(col).desc(), F.col("driver_code")], 2, "__rank")
    best = F.max(F.when(F.col("__rank") == 1, F.col(col)))
    second = F.max(F.when(F.col("__rank") == 2, F.col(col)))
    return first.groupBy(*keys).agg(
        F.max(F.when(F.col("__rank") == 1, F.col("driver_code"))).alias("driver_code"),
        best.alias(col),
        (best - F.coalesce(second, F.lit(0.0))).alias("margin"),
    )
