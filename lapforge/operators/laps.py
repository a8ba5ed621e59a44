"""Lap features: outlier filters, ordered windows, per-race aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapforge.constants import TEXT_NULLS
from lapforge.operators.groups import (
    BLOCK,
    attach,
    blocked,
    filled,
    with_group_stats,
    with_median,
    with_neighbours,
    with_rank,
    with_running_sum,
)
from lapforge.session import cut_lineage

EVENT = ["season_year", "round_number"]
RACE = [*EVENT, "session_type"]
DRIVER_RACE = [*RACE, "driver_code"]
STINT = [*DRIVER_RACE, "__stint"]
LAP = [*RACE, "lap_number"]
TIME = "lap_time_seconds"


def _prepared(df: DataFrame, spans: bool) -> tuple[DataFrame, str | None]:
    """Add the non-null stint key, and blocks unless the caller knows all groups to be small."""
    if "stint" in df.columns:
        df = filled(df, "stint")
    return (blocked(df), BLOCK) if spans else (df, None)


def _bare(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK, "__stint")


def filter_outliers(
    df: DataFrame,
    keys: Sequence[str] = STINT,
    col: str = TIME,
    factor: float = 1.10,
    spans: bool = True,
) -> DataFrame:
    """Keep positive times up to `factor` times the group's median.

    The median is taken over all rows of the group before any filter and is an actual
    element (the lower one of two); the limit is inclusive. Here and below, `spans`
    says whether groups can be too big for one task; False is for callers who know they
    cannot, as after staging, which leaves one row per driver, race and lap number.
    """
    df, block = _prepared(df, spans)
    return _bare(_filter_outliers(df, keys, col, factor, block))


def _filter_outliers(
    df: DataFrame, keys: Sequence[str], col: str, factor: float, block: str | None
) -> DataFrame:
    # Null times neither move the median nor pass the filter.
    timed = df.filter(F.col(col).isNotNull())
    if block is None:
        median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{col}`)")
        kept = with_group_stats(timed, keys, {"__median": median})
    else:
        kept = with_median(timed, keys, col, "__median", block)
    value = F.col(col)
    return kept.filter((value > 0) & (value <= F.col("__median") * factor)).drop("__median")


def filter_vs_best(
    df: DataFrame, keys: Sequence[str] = DRIVER_RACE, col: str = TIME, factor: float = 1.1
) -> DataFrame:
    """Keep times up to `factor` times the group's best."""
    kept = attach(df.filter(F.col(col).isNotNull()), keys, {"__best": F.min(col)})
    return kept.filter(F.col(col) <= F.col("__best") * factor).drop("__best")


def clean_compound(df: DataFrame, col: str = "compound", name: str = "clean_compound") -> DataFrame:
    """Turn textual nulls into NULL and keep everything else as written."""
    return df.withColumn(name, F.when(~F.upper(col).isin(TEXT_NULLS), F.col(col)))


def _mean(*values: Column) -> Column:
    """Mean of the non-null values, NULL if there are none."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return F.when(n > 0, total / F.nullif(n, F.lit(0)))


def _deviation(*values: Column) -> Column:
    """Sample standard deviation of the non-null values, NULL for fewer than two."""
    mean = _mean(*values)
    squares = [F.when(v.isNotNull(), (v - mean) * (v - mean)).otherwise(0.0) for v in values]
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return F.when(n > 1, F.sqrt(sum(squares[1:], squares[0]) / F.nullif(n - 1, F.lit(0))))


def lap_delta(
    df: DataFrame, keys: Sequence[str] = STINT, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Add `lap_delta`, the change from the previous lap of the stint."""
    df, block = _prepared(df, spans)
    out = with_neighbours(df, keys, "lap_number", col, back=1, block=block)
    out = out.withColumn("lap_delta", F.col(col) - F.col(f"{col}__prev1"))
    return _bare(out.drop(f"{col}__prev1"))


def stint_features(
    df: DataFrame, keys: Sequence[str] = STINT, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Add `lap_delta`, `rolling_delta_3` and `stint_lap_index` in one pass over the stint."""
    df, block = _prepared(df, spans)
    return _bare(_stint_features(df, keys, col, block))


def _stint_features(df: DataFrame, keys: Sequence[str], col: str, block: str | None) -> DataFrame:
    if block is None:
        stint = Window.partitionBy(*keys).orderBy("lap_number")
        return df.withColumns(
            {
                "lap_delta": F.col(col) - F.lag(col).over(stint),
                "stint_lap_index": F.row_number().over(stint),
            }
        ).withColumn("rolling_delta_3", F.avg("lap_delta").over(stint.rowsBetween(-1, 1)))
    out = with_neighbours(
        df, keys, "lap_number", col, back=2, ahead=1, index="stint_lap_index", block=block
    )
    now, before, before2, after = (F.col(c) for c in (col, f"{col}__prev1", f"{col}__prev2", f"{col}__next1"))
    out = out.withColumn("lap_delta", now - before).withColumn(
        "rolling_delta_3", _mean(before - before2, now - before, after - now)
    )
    return out.drop(f"{col}__prev1", f"{col}__prev2", f"{col}__next1")


def rolling_delta(
    df: DataFrame, keys: Sequence[str] = STINT, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Add `rolling_delta_3`, the lap delta averaged over the lap and its two neighbours."""
    return stint_features(df, keys, col, spans).drop("lap_delta", "stint_lap_index")


def stint_index(
    df: DataFrame, keys: Sequence[str] = STINT, spans: bool = True
) -> DataFrame:
    """Add `stint_lap_index`, the 1-based position of the lap in its stint."""
    df, block = _prepared(df, spans)
    order = "lap_number"
    return _bare(with_neighbours(df, keys, order, order, index="stint_lap_index", block=block))


def _with_best(df: DataFrame, keys: Sequence[str], col: str, spans: bool) -> DataFrame:
    """Add `__best`, the group's least value, NULL where a key is: joined back, or over the rows
    of groups known to be small, which reads and shuffles them once."""
    if spans:
        return attach(df, keys, {"__best": F.min(col)})
    out = with_group_stats(df, keys, {"__best": F.min(col)})
    known = reduce(and_, [F.col(key).isNotNull() for key in keys])
    return out.withColumn("__best", F.when(known, F.col("__best")))


def pace_delta(df: DataFrame, keys: Sequence[str] = LAP, col: str = TIME) -> DataFrame:
    """Add `pace_delta_to_leader`, the gap to the fastest time on the same lap."""
    return _pace_delta(_with_best(df, keys, col, spans=True), col)


def _pace_delta(out: DataFrame, col: str) -> DataFrame:
    return out.withColumn("pace_delta_to_leader", F.col(col) - F.col("__best")).drop("__best")


def rolling_consistency(
    df: DataFrame, keys: Sequence[str] = DRIVER_RACE, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Add `rolling_stddev_5` over five centred laps and `consistency_score` from it."""
    df, block = _prepared(df, spans)
    return _bare(_rolling_consistency(df, keys, col, block))


def _rolling_consistency(
    df: DataFrame, keys: Sequence[str], col: str, block: str | None
) -> DataFrame:
    score = 1.0 / (1.0 + F.coalesce("rolling_stddev_5", F.lit(0.0)))
    if block is None:
        near5 = Window.partitionBy(*keys).orderBy("lap_number").rowsBetween(-2, 2)
        out = df.withColumn("rolling_stddev_5", F.stddev_samp(col).over(near5))
        return out.withColumn("consistency_score", score)
    out = with_neighbours(df, keys, "lap_number", col, back=2, ahead=2, block=block)
    near = [f"{col}__prev2", f"{col}__prev1", f"{col}__next1", f"{col}__next2"]
    spread = _deviation(F.col(near[0]), F.col(near[1]), F.col(col), F.col(near[2]), F.col(near[3]))
    out = out.withColumn("rolling_stddev_5", spread).withColumn("consistency_score", score)
    return out.drop(*near)


def sector_deltas(
    df: DataFrame, keys: Sequence[str] = DRIVER_RACE, spans: bool = True
) -> DataFrame:
    """Add `s1_delta..s3_delta`, each sector time against its mean for the driver's race."""
    df, block = _prepared(df, spans)
    return _bare(_sector_deltas(df, keys, block))


def _sector_deltas(df: DataFrame, keys: Sequence[str], block: str | None) -> DataFrame:
    means = {f"__s{i}": F.avg(f"sector{i}_seconds") for i in (1, 2, 3)}
    out = with_group_stats(df, keys, means, block)
    deltas = {f"s{i}_delta": F.col(f"sector{i}_seconds") - F.col(f"__s{i}") for i in (1, 2, 3)}
    return out.withColumns(deltas).drop(*means)


def lap_rank(
    df: DataFrame, keys: Sequence[str] = LAP, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Add `lap_rank`, the rank of the time among all drivers on that lap; rows without a time get none."""
    if not spans:
        order = Window.partitionBy(*keys).orderBy(F.col(col).asc_nulls_last())
        return df.withColumn("lap_rank", F.when(F.col(col).isNotNull(), F.rank().over(order)))
    return with_rank(df, keys, col, "lap_rank", step=0.5)


def driver_race_features(df: DataFrame, spans: bool = True) -> DataFrame:
    """Aggregate featured laps to one row per driver and race.

    Laps are first summed per stint and compound, which hashes numbers only and
    combines on the map side; distinct counts and the first compound then work on
    those few rows. Without `spans`, a driver's race has hardly fewer stints and compounds
    than laps and few of either, so one aggregate does it all. On equal lap numbers the first
    compound goes by name.
    """
    keys = ["season_year", "round_number", "circuit_name", "driver_code"]
    means = {
        "avg_lap_time": (TIME, 3),
        "avg_consistency": ("consistency_score", 3),
        "avg_pace_delta": ("pace_delta_to_leader", 3),
        "avg_degradation_per_lap": ("lap_delta", 4),
        "avg_smoothed_degradation": ("rolling_delta_3", 4),
        "avg_s1_delta": ("s1_delta", 3),
        "avg_s2_delta": ("s2_delta", 3),
        "avg_s3_delta": ("s3_delta", 3),
    }
    if not spans:
        known = F.when(F.col("clean_compound").isNotNull(), F.struct("lap_number", "clean_compound"))
        return clean_compound(df).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_laps"),
            F.round(F.min(TIME), 3).alias("fastest_lap"),
            F.round(F.max(TIME), 3).alias("slowest_lap"),
            F.round(F.stddev_samp(TIME), 3).alias("lap_time_stddev"),
            F.size(F.collect_set("stint")).cast("long").alias("num_stints"),
            F.size(F.collect_set("clean_compound")).cast("long").alias("num_compounds"),
            F.min(known)["clean_compound"].alias("starting_compound"),
            *[(F.round(F.avg(c), places) + F.lit(0.0)).alias(name) for name, (c, places) in means.items()],
        )
    n, squares = F.col("__n"), F.col("__n") * F.col("__mean") * F.col("__mean")
    parts = clean_compound(df).groupBy(*keys, "stint", "clean_compound").agg(
        F.count(F.lit(1)).alias("__laps"),
        F.count(TIME).alias("__n"),
        F.avg(TIME).alias("__mean"),
        F.var_pop(TIME).alias("__var"),
        F.min(TIME).alias("__min"),
        F.max(TIME).alias("__max"),
        F.min("lap_number").alias("__first"),
        *[F.sum(c).alias(f"__sum_{c}") for c, _ in means.values()],
        *[F.count(c).alias(f"__count_{c}") for c, _ in means.values()],
    )

    def mean(col: str, places: int) -> Column:
        # Adding zero turns a negative zero into zero.
        known = F.nullif(F.sum(f"__count_{col}"), F.lit(0))
        return F.round(F.sum(f"__sum_{col}") / known, places) + F.lit(0.0)

    total, average = F.sum(n), F.sum(n * F.col("__mean")) / F.nullif(F.sum(n), F.lit(0))
    scatter = F.sum(n * F.col("__var")) + F.sum(squares) - total * average * average
    variance = F.when(total > 1, F.greatest(scatter, F.lit(0.0)) / F.nullif(total - 1, F.lit(0)))
    known = F.when(F.col("clean_compound").isNotNull(), F.struct("__first", "clean_compound"))
    return parts.groupBy(*keys).agg(
        F.sum("__laps").alias("total_laps"),
        F.round(F.min("__min"), 3).alias("fastest_lap"),
        F.round(F.max("__max"), 3).alias("slowest_lap"),
        F.round(F.sqrt(variance), 3).alias("lap_time_stddev"),
        F.count_distinct("stint").alias("num_stints"),
        F.count_distinct("clean_compound").alias("num_compounds"),
        F.min(known)["clean_compound"].alias("starting_compound"),
        *[mean(c, places).alias(name) for name, (c, places) in means.items()],
    )


def lap_features(df: DataFrame, spans: bool = True) -> DataFrame:
    """Filter outliers and add every lap-level feature.

    Without `spans`, the drivers of a race weekend are few too: one shuffle by weekend serves
    all windows and the aggregates after them, and one order the median and the stint windows.
    Where groups are blocked, the best time per lap is a map-side combined aggregate joined back,
    and each stage reads its input twice, so stages are cut by a checkpoint.
    """
    df, block = _prepared(df, spans)
    if block is None:
        cut = lambda stage: stage
        df = df.repartition(*EVENT).sortWithinPartitions(*STINT, "lap_number")
    else:
        cut = cut_lineage
    out = cut(_filter_outliers(df, STINT, TIME, 1.10, block))
    out = cut(_stint_features(out, STINT, TIME, block))
    out = cut(_rolling_consistency(out, DRIVER_RACE, TIME, block))
    out = cut(_sector_deltas(out, DRIVER_RACE, block))
    return _pace_delta(_with_best(_bare(out), LAP, TIME, spans), TIME)


def race_feature_set(df: DataFrame, spans: bool = True) -> DataFrame:
    """Laps in, one feature row per driver and race out; without `spans` nothing runs until an action."""
    return driver_race_features(lap_features(df, spans), spans)


def lap_consistency(
    df: DataFrame, keys: Sequence[str] = DRIVER_RACE, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Consistency per group: 1 minus ten times the variation of laps near the best one."""
    near = _with_best(df.filter(F.col(col).isNotNull()), keys, col, spans)
    ok = F.when(F.col(col) <= F.col("__best") * 1.1, F.col(col))
    stats = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_laps"),
        F.count(ok).alias("__near"),
        (F.stddev_samp(ok) / F.avg(ok)).alias("__cv"),
    )
    score = (
        F.when(F.col("valid_laps") <= 1, 1.0)
        .when(F.col("__near") <= 1, 0.5)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("__cv") * 10))
    )
    return stats.select(*keys, "valid_laps", score.alias("consistency"))


def session_summary(df: DataFrame, keys: Sequence[str] = DRIVER_RACE, col: str = TIME) -> DataFrame:
    """Per driver and session: lap counts, fastest, mean, consistency and distinct positions.

    Drivers without a timed lap are left out.
    """
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_laps"),
        F.min(col).alias("fastest_lap"),
        F.avg(col).alias("average_lap"),
        F.sort_array(F.collect_set("position")).alias("positions"),
    )
    return totals.join(lap_consistency(df, keys, col), list(keys))


def gap_to_leader(
    df: DataFrame, keys: Sequence[str] = DRIVER_RACE, col: str = TIME, spans: bool = True
) -> DataFrame:
    """Add `gap_to_leader`: race time so far against the least race time on that lap."""
    df, block = _prepared(df, spans)
    summed = with_running_sum(df, keys, "lap_number", col, "race_time", block)
    race = [k for k in keys if k != "driver_code"]
    out = attach(summed, [*race, "lap_number"], {"__least": F.min("race_time")})
    gap = F.col("race_time") - F.col("__least")
    return _bare(out.withColumn("gap_to_leader", gap).drop("__least"))


def order_fraction(df: DataFrame, keys: Sequence[str] = LAP, col: str = "position") -> DataFrame:
    """Add `order_fraction`: 0 for the first car on the lap, 1 for the last."""
    out = attach(df, keys, {"__cars": F.count(F.lit(1))})
    share = (F.col(col) - 1) / F.greatest(F.col("__cars") - 1, F.lit(1))
    return out.withColumn("order_fraction", share).drop("__cars")


def wear_fraction(
    df: DataFrame, keys: Sequence[str] = STINT, col: str = "tyre_life", spans: bool = True
) -> DataFrame:
    """Add `wear_fraction`: tyre age against the oldest age in the stint."""
    df, block = _prepared(df, spans)
    out = with_group_stats(df, keys, {"__oldest": F.max(col)}, block)
    out = out.withColumn("wear_fraction", F.col(col) / F.nullif(F.col("__oldest"), F.lit(0)))
    return _bare(out.drop("__oldest"))


def scale_to_max(df: DataFrame, keys: Sequence[str], col: str, name: str = "scaled") -> DataFrame:
    """Add abs(x) divided by the largest abs(x) of the group."""
    out = attach(df, keys, {"__peak": F.max(F.abs(col))})
    return out.withColumn(name, F.abs(col) / F.nullif(F.col("__peak"), F.lit(0.0))).drop("__peak")


def inverse_scale(df: DataFrame, keys: Sequence[str], col: str, name: str = "bar_width") -> DataFrame:
    """Add a width that shrinks from 100 as `col` grows, never below 15."""
    out = attach(df, keys, {"__peak": F.max(col)})
    width = F.greatest(F.lit(15.0), 100 - (F.col(col) - 1) / F.col("__peak") * 80)
    return out.withColumn(name, width).drop("__peak")
