"""Records as they stood at a moment: aggregates over strictly earlier rows, for many moments in one plan.

Facts are first aggregated per key and moment, with map-side combine, so the window that runs over
a key's history sees one row per moment, however many facts there are. The states must merge
(sum, min, max); averages and deviations follow from sums. Moments asked for and moments of facts
go through one window, so a key without facts at a moment still finds what came before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
State = tuple[str, Column]


def before(
    asked: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    states: Mapping[str, State],
    at: str = "season_year",
    by: Sequence[str] = (),
) -> DataFrame:
    """For every distinct (keys, `at`) of `asked`, each state merged over the facts of the same keys
    at a lower `at`; null where there are none. `states` maps a name to its merge and its column.

    Rows with a null key meet each other, as in a grouping; facts at a null moment are in no past.

    With `by`, some of the keys that few facts share, moments and facts are dealt once by them and
    all else happens there, over the facts as they are; what comes out still lies by them. `at` is
    then a whole number.
    """
    keys = list(keys)
    if by:
        return _before_dealt(asked, facts, keys, states, at, by)
    steps = facts.filter(F.col(at).isNotNull()).groupBy(*keys, at)
    steps = steps.agg(*[MERGE[how](c).alias(name) for name, (how, c) in states.items()])
    probes = asked.select(*keys, at).distinct().withColumn("__fact", F.lit(False))
    rows = probes.unionByName(steps.withColumn("__fact", F.lit(True)), allowMissingColumns=True)
    # A probe comes before the facts of its own moment.
    past = Window.partitionBy(*keys).orderBy(at, "__fact").rowsBetween(Window.unboundedPreceding, -1)
    merged = rows.withColumns({name: MERGE[how](name).over(past) for name, (how, _) in states.items()})
    return merged.filter(~F.col("__fact")).drop("__fact")


def _before_dealt(
    asked: DataFrame, facts: DataFrame, keys: list[str], states: Mapping[str, State], at: str, by: Sequence[str]
) -> DataFrame:
    probes = asked.select(*keys, at).withColumn("__fact", F.lit(False))
    rows = probes.unionByName(facts.withColumn("__fact", F.lit(True)), allowMissingColumns=True).repartition(*by)
    known = F.col("__fact") & F.col(at).isNotNull()
    # One order serves all: the facts of earlier moments, and the first of equal probes.
    rows = rows.sortWithinPartitions(*keys, at, "__fact")
    past = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys, at).orderBy("__fact"))
    merged = rows.select(
        *keys, at, "__fact", *[MERGE[how](F.when(known, c)).over(past).alias(name) for name, (how, c) in states.items()]
    )
    return merged.withColumn("__lead", first).filter("NOT __fact AND __lead = 1").drop("__fact", "__lead")
