"""Per-group work that stays distributed when one group is huge.

A plain window puts every row of its partition key into one task. That is the best
plan while groups are small, which callers must know: staging leaves one row per driver,
race and lap number, and a race has a bounded number of laps.

Otherwise (`block` given) a group is cut into *blocks* along its own order, work
happens inside blocks, and only a few values per block cross block borders.

Group keys are expected to be non-null (staging guarantees it); wrap a nullable one
with `filled` first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAP_BLOCK = 4096
BLOCK = "__block"


def blocked(df: DataFrame, order: str = "lap_number", size: int | None = None) -> DataFrame:
    """Add the block column: which stretch of `order` a row lies in."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(size or LAP_BLOCK)).cast("long"))


def filled(df: DataFrame, column: str, name: str = "__stint", value: int = -1) -> DataFrame:
    """Add `name`, a copy of a nullable key column with nulls replaced by `value`."""
    return df.withColumn(name, F.coalesce(F.col(column), F.lit(value)))


def attach(
    df: DataFrame,
    keys: Sequence[str],
    stats: Mapping[str, Column],
    block: str | None = None,
    how: str = "left",
) -> DataFrame:
    """Add group aggregates to every row: aggregate with map-side combine, then join back.

    With `block`, rows are joined on (keys, block) and the one aggregate row of a group
    is repeated for each of its blocks, so the rows of a huge group spread over many
    tasks. Without it the join is on the keys and adaptive execution splits hot ones.
    """
    aggregates = [column.alias(name) for name, column in stats.items()]
    if block is None:
        return df.join(df.groupBy(*keys).agg(*aggregates), list(keys), how)
    low, high = F.min(block).alias("__low"), F.max(block).alias("__high")
    right = (
        df.groupBy(*keys)
        .agg(*aggregates, low, high)
        .withColumn(block, F.explode(F.sequence("__low", "__high")))
        .drop("__low", "__high")
    )
    return df.join(right, [*keys, block], how)


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], block: str | None = None
) -> DataFrame:
    """Add group aggregates to every row of groups known to be small, or of blocked ones."""
    if block is not None:
        return attach(df, keys, stats, block)
    group = Window.partitionBy(*keys)
    return df.withColumns({name: column.over(group) for name, column in stats.items()})


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    back: int = 0,
    ahead: int = 0,
    index: str | None = None,
    block: str | None = None,
) -> DataFrame:
    """Add the `value` of the rows before and after each row of its group.

    Columns `<value>__prev1..back` and `<value>__next1..ahead` hold the neighbours in
    `order`, `index` the 1-based position. With `block`, only the first and last few
    values and the row count of each block cross block borders.
    """
    if block is None:
        window = Window.partitionBy(*keys).orderBy(order)
        near = {f"{value}__prev{i}": F.lag(value, i).over(window) for i in range(1, back + 1)}
        near |= {f"{value}__next{i}": F.lead(value, i).over(window) for i in range(1, ahead + 1)}
        if index:
            near[index] = F.row_number().over(window)
        return df.withColumns(near)
    reach = max(back, ahead, 1)
    inner = Window.partitionBy(*keys, block).orderBy(order)
    every = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = df.withColumns(
        {
            "__rn": F.row_number().over(inner),
            "__n": F.count(F.lit(1)).over(every),
            **{f"{value}__prev{i}": F.lag(value, i).over(inner) for i in range(1, back + 1)},
            **{f"{value}__next{i}": F.lead(value, i).over(inner) for i in range(1, ahead + 1)},
        }
    )
    first, last = F.col("__rn") <= reach, F.col("__rn") > F.col("__n") - reach
    edges = (
        local.filter(first | last)
        .groupBy(*keys, block)
        .agg(
            F.max("__n").alias("__size"),
            F.array_sort(F.collect_list(F.struct("__rn", F.col(value).alias("v")))).alias("__edge"),
        )
        .select(
            *keys,
            block,
            "__size",
            F.expr(f"transform(filter(__edge, e -> e.__rn <= {reach}), e -> e.v)").alias("__head"),
            F.expr(f"transform(filter(__edge, e -> e.__rn > __size - {reach}), e -> e.v)").alias("__tail"),
        )
    )
    outer = Window.partitionBy(*keys).orderBy(block)
    carried = (
        edges.withColumns(
            {
                "__before": F.flatten(F.collect_list("__tail").over(outer.rowsBetween(-reach, -1))),
                "__after": F.flatten(F.collect_list("__head").over(outer.rowsBetween(1, reach))),
                "__offset": F.sum("__size").over(outer.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
        .filter((F.size("__before") > 0) | (F.size("__after") > 0))
        .select(*keys, block, "__before", "__after", "__offset")
    )
    joined = local.join(carried, [*keys, block], "left")
    out = {}
    for i in range(1, back + 1):
        name = f"{value}__prev{i}"
        across = F.try_element_at("__before", (F.col("__rn") - F.lit(i + 1)).cast("int"))
        out[name] = F.when(F.col("__rn") > i, F.col(name)).otherwise(across)
    for i in range(1, ahead + 1):
        name = f"{value}__next{i}"
        across = F.try_element_at("__after", (F.col("__rn") + F.lit(i) - F.col("__n")).cast("int"))
        out[name] = F.when(F.col("__rn") + i <= F.col("__n"), F.col(name)).otherwise(across)
    if index:
        out[index] = (F.col("__rn") + F.coalesce(F.col("__offset"), F.lit(0))).cast("int")
    return joined.withColumns(out).drop("__rn", "__n", "__before", "__after", "__offset")


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    block: str | None = None,
) -> DataFrame:
    """Add the running total of `value` in `order`; with `block`, one sum per block is carried."""
    if block is None:
        window = Window.partitionBy(*keys).orderBy(order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.coalesce(F.sum(value).over(upto), F.lit(0.0)))
    inner = Window.partitionBy(*keys, block).orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*keys).orderBy(block)
    earlier = (
        df.groupBy(*keys, block)
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__offset", F.sum("__sum").over(outer.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("__offset").isNotNull())
        .select(*keys, block, "__offset")
    )
    return (
        df.withColumn("__local", F.sum(value).over(upto))
        .join(earlier, [*keys, block], "left")
        .withColumn(name, F.coalesce("__local", F.lit(0.0)) + F.coalesce("__offset", F.lit(0.0)))
        .drop("__local", "__offset")
    )


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    descending: bool = False,
    tiebreak: str | None = None,
    step: float | None = None,
    parts: int = 1024,
) -> DataFrame:
    """Add the rank of `value` in its group; null values get no rank.

    Ties share a rank unless `tiebreak` orders them. Shared ranks are those of the different
    values, each counted once (`with_shared_rank`). Otherwise a group is cut into stretches of
    `step`, or into `parts` equal ones between its least and greatest value; rows are ranked inside
    stretches, and only row counts per stretch cross their borders. Rows of one value are then
    ordered in one place, by the tiebreak.
    """
    if tiebreak is None:
        return with_shared_rank(df, keys, value, name, descending, step, min(parts, 64))
    keys, columns = list(keys), df.columns
    signed = -F.col(value) if descending else F.col(value)
    df = df.withColumn("__v", signed)
    if step is None:
        bounds = df.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        df = df.join(bounds, keys)
        span = F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
        part = F.coalesce(F.floor((F.col("__v") - F.col("__low")) / span * parts), F.lit(0))
    else:
        part = F.floor(F.col("__v") / F.lit(step))
    # Rows without a value need no order; they are only kept apart and spread out.
    aside = F.lit(-(2**40)) - F.pmod(F.xxhash64(*columns), F.lit(64))
    known = F.col("__v").isNotNull()
    df = df.withColumn("__part", F.when(known, part).otherwise(aside))
    outer = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lower = (
        df.filter(known)
        .groupBy(*keys, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(outer), F.lit(0)))
        .drop("__n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__v", tiebreak))
    rank = F.when(known, F.col("__local") + F.col("__offset")).cast("int")
    return (
        df.withColumn("__local", local)
        .join(lower, [*keys, "__part"], "left")
        .withColumn(name, rank)
        .drop("__v", "__low", "__high", "__part", "__local", "__offset")
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, null as one more value; the right side's are named with two underscores before."""
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(right[f"__{key}"])
    return same


def joined_on(df: DataFrame, keys: Sequence[str], facts: DataFrame, how: str = "left") -> DataFrame:
    """`df` with the columns of `facts`, one row per `keys`, joined so that null keys meet."""
    renamed = facts.withColumnsRenamed({key: f"__{key}" for key in keys})
    return df.join(renamed, _same(df, renamed, keys), how).drop(*[f"__{key}" for key in keys])


def _in_stretches(counts: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """Add `__part` to rows of (keys, value, `__n`): which of about `parts` stretches of the group's
    different values a value lies in, by borders from a sketch of bounded size. Any borders give
    right results; even ones give even work."""
    shares = [i / parts for i in range(1, parts)]
    borders = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("__borders"))
    below = F.size(F.filter("__borders", lambda b: b < F.col(value)))
    return joined_on(counts, keys, borders).withColumn("__part", below).drop("__borders")


def with_shared_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    descending: bool = False,
    step: float | None = None,
    parts: int = 64,
) -> DataFrame:
    """Add the rank of `value` in its group, shared by equal values; null values get no rank.

    Rows are counted per value with map-side combine, so a value that most of a group shares is one
    row per task. The different values are ordered inside stretches, of `step` where the spread of
    values is known, else of about even numbers of them; a stretch passes on its count. Ranks are joined back to the rows by group and value, where
    adaptive execution splits hot ones.
    """
    keys = list(keys)
    rows = df.withColumn("__v", -F.col(value) if descending else F.col(value))
    counts = rows.filter(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    if step is None:
        counts = _in_stretches(counts, keys, "__v", parts)
    else:
        counts = counts.withColumn("__part", F.floor(F.col("__v") / F.lit(step)))
    upto = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    passed = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__held"))
    passed = passed.withColumn("__before", F.coalesce(F.sum("__held").over(earlier), F.lit(0))).drop("__held")
    inside = counts.withColumn("__inside", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    ranks = joined_on(inside, [*keys, "__part"], passed).select(
        *keys, "__v", (F.col("__inside") + F.col("__before") + 1).cast("int").alias(name)
    )
    return joined_on(rows.drop(name), [*keys, "__v"], ranks).drop("__v")


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, str], parts: int = 64
) -> DataFrame:
    """One row per group with the exact lower quantiles of the non-null `value`: each the least value
    that at least that share of the values do not exceed. `shares` maps names to decimal shares.

    All quantiles come from one pass: values are counted, cut into stretches, and only the stretches
    that hold a wanted place are put in order. No task holds a group's values, however many.
    """
    keys, names = list(keys), list(shares)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    counts = _in_stretches(counts, keys, value, parts)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    held = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__held")).withColumns(
        {"__before": F.coalesce(F.sum("__held").over(earlier), F.lit(0)), "__all": F.sum("__held").over(group)}
    )
    places = F.array(
        *[
            F.struct(F.lit(i).alias("__q"), F.greatest(F.ceil(F.lit(Decimal(s)) * F.col("__all")).cast("long"), F.lit(1)).alias("__place"))
            for i, s in enumerate(shares.values())
        ]
    )
    wanted = held.select(*keys, "__part", "__before", "__held", F.inline(places)).filter(
        (F.col("__place") > F.col("__before")) & (F.col("__place") <= F.col("__before") + F.col("__held"))
    )
    wanted = wanted.select(*keys, "__part", "__q", (F.col("__place") - F.col("__before")).alias("__place"))
    upto = Window.partitionBy(*keys, "__part", "__q").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = joined_on(counts, [*keys, "__part"], wanted, "inner").withColumn("__upto", F.sum("__n").over(upto))
    reached = ordered.filter(F.col("__upto") >= F.col("__place"))
    return reached.groupBy(*keys).agg(
        *[F.min(F.when(F.col("__q") == i, F.col(value))).alias(name) for i, name in enumerate(names)]
    )


def with_median(df: DataFrame, keys: Sequence[str], value: str, name: str, block: str) -> DataFrame:
    """Add the exact lower median of the non-null `value` to every row of a blocked group of any size.

    Values fall into three stretches, with a thin one around the middle by a sketch of bounded
    size. Only the stretch that holds the median is put in order, one row per different value.
    A poor sketch would make that stretch longer, never the median wrong.
    """
    keys, v = list(keys), F.col(value)
    # Rows of no block count towards the median, too.
    rows = df.select(*keys, F.coalesce(block, F.lit(0)).alias(block), v)
    borders = {"__borders": F.percentile_approx(value, [0.499, 0.501], 10_000)}
    parted = attach(rows, keys, borders, block).withColumn(
        "__part", F.when(v < F.col("__borders")[0], 0).when(v <= F.col("__borders")[1], 1).otherwise(2)
    )
    # The median's place among the rows of its stretch, for each block of the group.
    before = [F.lit(0), F.col("__n0"), F.col("__n0") + F.col("__n1")]
    counts = parted.groupBy(*keys).agg(
        *[F.count_if(F.col("__part") == i).alias(f"__n{i}") for i in (0, 1)],
        F.ceil(F.count(F.lit(1)) / 2).alias("__place"),
        F.min(block).alias("__low"),
        F.max(block).alias("__high"),
    )
    chosen = F.when(F.col("__place") <= before[1], 0).when(F.col("__place") <= before[2], 1).otherwise(2)
    places = counts.withColumn("__part", chosen).select(
        *keys,
        "__part",
        (F.col("__place") - F.element_at(F.array(*before), F.col("__part") + 1)).alias("__place"),
        F.explode(F.sequence("__low", "__high")).alias(block),
    )
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    medians = (
        parted.join(places, [*keys, block, "__part"])
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"), F.first("__place").alias("__place"))
        .withColumn("__upto", F.sum("__n").over(upto))
        .filter(F.col("__upto") >= F.col("__place"))
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )
    spread = counts.select(*keys, F.explode(F.sequence("__low", "__high")).alias(block)).join(medians, keys)
    return df.join(spread, [*keys, block], "left")


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """Keep the first `n` rows of each group; `rank` names the kept position.

    The limit is applied before the shuffle as well, so a huge group sends at most
    `n` rows per input task.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def grams(text: Column, size: int = 3) -> Column:
    """Distinct substrings of `size` letters; a shorter text is its only one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(size - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _holders(outer: DataFrame, inner: DataFrame, outer_text: str, inner_text: str, keys: list[str], size: int) -> DataFrame:
    """Pairs whose `outer` text may contain the `inner` one of at least `size` letters, or equals one of fewer.

    Whatever contains a text contains each of its grams, so the rarest one will do: counted
    over the distinct outer texts, chosen once per distinct inner text. Sizes known before texts
    are cut say nothing about the grams, so neither side is sent whole: both are sorted and merged.
    """
    counts = outer.select(outer_text).distinct().select(F.explode(grams(F.col(outer_text), size)).alias("__gram"))
    counts = counts.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = (
        inner.select(F.col(inner_text).alias("__inner"))
        .distinct()
        .withColumn("__gram", F.explode(grams(F.col("__inner"), size)))
        .join(counts.hint("merge"), "__gram", "left")
        .groupBy("__inner")
        .agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__least"))
        .filter("__least.n > 0")
        .select("__inner", F.col("__least.__gram").alias("__gram"))
    )
    keyed = inner.join(rarest.hint("merge"), inner[inner_text] == rarest["__inner"]).drop("__inner")
    cut = outer.withColumn("__gram", F.explode(grams(F.col(outer_text), size)))
    return cut.join(keyed.hint("merge"), [*keys, "__gram"])


def _if_any(df: DataFrame, others: DataFrame) -> DataFrame:
    """`df`, or none of its rows where `others` has none; one row of it is sent."""
    return df.join(F.broadcast(others.select(F.lit(1).alias("__any")).limit(1))).drop("__any")


def contains_join(
    left: DataFrame,
    right: DataFrame,
    left_text: str,
    right_text: str,
    keys: Sequence[str] = (),
    longest: int = 3,
) -> DataFrame:
    """Pairs where one text contains the other, found through an equi-join; no cross join.

    Texts of `longest` letters or more meet the ones that contain them at their rarest gram of
    that size, shorter ones (a bounded number of different texts) at a gram of their own size.
    """
    keys, parts = list(keys), []
    for size in range(1, longest + 1):
        of_size = (lambda c: F.length(c) >= size) if size == longest else (lambda c: F.length(c) == size)  # noqa: B023
        short_right, short_left = right.filter(of_size(right_text)), left.filter(of_size(left_text))
        in_left = _holders(_if_any(left, short_right), short_right, left_text, right_text, keys, size)
        in_right = _holders(_if_any(right, short_left), short_left, right_text, left_text, keys, size)
        parts.append(in_left.filter(F.contains(left_text, right_text)))
        parts.append(in_right.filter(F.contains(right_text, left_text) & (F.col(left_text) != F.col(right_text))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("__gram")


def held_join(texts: DataFrame, names: DataFrame, text: str, name: str, longest: int = 3) -> DataFrame:
    """Pairs of a text and a name inside it, for any number of names: a name meets the texts that hold
    its rarest gram, so the cost goes with the length of the texts and the pairs met, not with texts
    times names. Empty names are in no text; letters count as they are."""
    parts = []
    for size in range(1, longest + 1):
        of_size = (F.length(name) >= size) if size == longest else (F.length(name) == size)
        sized = names.filter(of_size)
        parts.append(_holders(_if_any(texts, sized), sized, text, name, [], size).filter(F.contains(text, name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("__gram")
