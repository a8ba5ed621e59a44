"""Prefix trie of rebuilt conversations, found by composable fingerprints.

A conversation is rebuilt from the first turns of its base and its own later turns. No rebuilt
text is ever made: a sequence of turns has the fingerprint (n, q) with q = sum of t_i * r^i over
its turns, modulo a prime, and sequences compose as (n, q)(m, s) = (n + m, q + r^n * s). So the
fingerprint of every rebuilt prefix follows from sums over the base's head and the conversation's
own suffix. Rebuilt prefixes with one depth and fingerprint form a node.

Equality is exact. A turn's reference is 120 bits of a digest of its role and text; `_ambiguous`
proves that no two different turns of the table share one, and `_disagreeing` that all members of
a node store the same last reference. Their parents' fingerprints are then equal too, so by
induction all turns agree. If either proof fails, everything is done again with another salt.

Rows without a conversation id take no part. Null roles and texts are empty. Rows of one turn
number are ordered by the digest of their content, so repeated rows are turns of their own with a
defined order. No rows: no conversation, no node, not even a root. Other columns are ignored.
Conversations are cut into blocks of turn numbers, rebuilt ones into blocks of depth, so one
conversation with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapforge.session import cut_lineage

BLOCK = 4096  # turn numbers, or depths, in one block
IDS = 1024  # conversation ids in one stretch
PARTS = 64  # parts of the children of one node
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1664525, 1220703125)
LANES = ("q1", "q2", "q3")
REF = ("t1", "t2")
SALTS = 8


@dataclass(frozen=True)
class Rebuild:
    """How a conversation is rebuilt: whose first turns it takes, and how many (at most `most`)."""

    base: Column
    head: Column
    most: int


def _numbers(values: list[int]) -> str:
    """SQL of a constant array; a literal is folded once, faster than an expression per number."""
    return f"CAST(split('{','.join(map(str, values))}', ',') AS array<bigint>)"


def _power(lane: int, k: str) -> str:
    """SQL of r^k modulo the lane's prime for 0 <= k < 2^32, by bytes of the exponent."""
    p, out = PRIMES[lane], ""
    for byte in range(4):
        step = pow(BASES[lane], 1 << (8 * byte), p)
        table = _numbers([pow(step, e, p) for e in range(256)])
        factor = f"get({table}, CAST(shiftright({k}, {8 * byte}) & 255 AS INT))"
        out = f"{out} * {factor} % {p}" if out else factor
    return f"({out})"


def _content(role: str, text: str, salt: int) -> Column:
    """Digest of a turn; the role's length keeps role and text apart."""
    role_text, said = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    mark = F.lit(f"{salt} " if salt else "")
    return F.md5(F.concat(mark, F.octet_length(role_text).cast("string"), F.lit(":"), role_text, said).cast("binary"))


def _turns(df: DataFrame, salt: int) -> DataFrame:
    """One row per turn: conversation, block, turn, order of content, reference, words."""
    digest = _content("role", "text", salt)
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    parts = [F.conv(F.substring("__digest", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(REF[i]) for i in (0, 1)]
    return (
        df.select("conv_id", "turn", words.cast("bigint").alias("words"), digest.alias("__digest"),
                  _content("role", "text", 0).alias("content"))
        .withColumn("block", F.floor(F.col("turn") / F.lit(BLOCK)).cast("bigint"))
        .select("conv_id", "turn", "block", "content", "words", *parts)
    )


def _ambiguous(df: DataFrame, salt: int) -> bool:
    """Whether two different turns share a reference."""
    plain = df.select(
        F.left(_content("role", "text", salt), F.lit(30)).alias("ref"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    shared = plain.groupBy("ref", "role", "text").count().groupBy("ref").count().filter("count > 1")
    return not shared.isEmpty()


def _positions(turns: DataFrame) -> DataFrame:
    """Turns with their place `k` in the conversation and the fingerprint lanes of the first k turns.

    Inside a block both are running sums; a block is composed with all blocks before it, of which
    only (count, lanes) cross its border. Turns without a number form a first block of their own.
    """
    turns = turns.withColumn("block", F.coalesce("block", F.lit(-(2**62))))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "content")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = turns.withColumn("k", F.row_number().over(inner).cast("bigint"))
    terms = {q: F.expr(f"{_lane(i)} * {_power(i, 'k')} % {p}") for i, (q, p) in enumerate(zip(LANES, PRIMES, strict=True))}
    local = local.withColumns(terms).withColumns({q: F.sum(q).over(upto) % PRIMES[i] for i, q in enumerate(LANES)})
    last = local.groupBy("conv_id", "block").agg(
        F.max("k").alias("n"), *[F.max_by(q, "k").alias(f"b{q}") for q in LANES]
    )
    outer = Window.partitionBy("conv_id").orderBy("block")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    blocks = last.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    moved = [f"b{q} * {_power(i, 'skip')} % {PRIMES[i]} AS b{q}" for i, q in enumerate(LANES)]
    blocks = blocks.selectExpr("conv_id", "block", "skip", *moved)
    blocks = blocks.select("conv_id", "block", "skip", *[F.sum(f"b{q}").over(before).alias(f"b{q}") for q in LANES])
    # What crosses borders is needed in later blocks only.
    joined = local.join(blocks.filter("skip > 0"), ["conv_id", "block"], "left")
    joined = joined.na.fill(0, ["skip", *[f"b{q}" for q in LANES]])
    lanes = [f"(b{q} + {q} * {_power(i, 'skip')}) % {PRIMES[i]} AS {q}" for i, q in enumerate(LANES)]
    return joined.selectExpr("conv_id", "block", "k + skip AS k", *lanes, *REF, "words")


def _lane(i: int, t1: str = "t1", t2: str = "t2") -> str:
    """SQL of the turn's number in a lane."""
    return f"({(t1, t2, f'({t1} + {t2})')[i]} % {PRIMES[i]})"


def _rebuilt(places: DataFrame, how: Rebuild) -> tuple[DataFrame, DataFrame]:
    """(one row per rebuilt prefix of one turn or more, one row per conversation with its rebuilt length)."""
    few = F.struct("k", *LANES, *REF, "words")
    heads = places.groupBy("conv_id").agg(
        F.max("k").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= how.most, few))).alias("head")
    )
    heads = cut_lineage(heads)
    bases = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    convs = (
        heads.withColumns({"base": how.base, "h": how.head.cast("int")})
        .join(bases, "base", "left")
        .selectExpr("conv_id", "n", "head", "coalesce(slice(base_head, 1, h), slice(head, 1, 0)) AS base_head", "least(h, n) AS dropped")
        .selectExpr("*", "size(base_head) AS taken")
    )
    # Lanes of the base's head, and of the conversation's own head whose place it takes.
    given = [f"coalesce(get(base_head, taken - 1).{q}, 0) AS g{q}" for q in LANES]
    own_head = [f"coalesce(get(head, CAST(dropped AS INT) - 1).{q}, 0) AS o{q}" for q in LANES]
    convs = cut_lineage(convs.selectExpr("conv_id", "n", "base_head", "taken", "dropped", *given, *own_head))
    lengths = convs.selectExpr("conv_id", "taken + n - dropped AS length")
    from_base = convs.select("conv_id", F.inline("base_head")).withColumnRenamed("k", "depth")
    # One row per block of a conversation, so that its turns meet it in many tasks.
    blocks = places.select("conv_id", "block").distinct()
    per_block = blocks.join(convs.drop("base_head", "n"), "conv_id")
    own = places.join(per_block, ["conv_id", "block"]).filter("k > dropped")
    lanes = []
    for i, (q, p) in enumerate(zip(LANES, PRIMES, strict=True)):
        # The suffix moves by taken - dropped places; powers of r from -most to most.
        shifts = _numbers([pow(BASES[i], e, p) for e in range(-how.most, how.most + 1)])
        shift = f"get({shifts}, CAST(taken - dropped + {how.most} AS INT))"
        lanes.append(f"(g{q} + {shift} * (({q} - o{q} + {p}) % {p})) % {p} AS {q}")
    own = own.selectExpr("conv_id", "k - dropped + taken AS depth", *lanes, *REF, "words")
    return from_base.select(own.columns).unionByName(own), lengths


KEY = ("depth", *LANES)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node below the root: members, the least of them, and the last turn."""
    ends = [f(t).alias(f"{name}_{t}") for t in REF for name, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *ends
    )


def _disagreeing(nodes: DataFrame) -> bool:
    """Whether members of a node differ in their last turn."""
    return not nodes.filter(" OR ".join(f"low_{t} <> high_{t}" for t in REF)).isEmpty()


def _later_sums(df: DataFrame, values: list[str]) -> DataFrame:
    """Add `all_<value>`: the sum over this and all greater depths of the conversation."""
    df = df.withColumn("part", F.floor(F.col("depth") / BLOCK))
    outer = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("conv_id", "part").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select("conv_id", "part", *[F.sum(v).over(outer).alias(f"more_{v}") for v in values])
    totals = totals.filter(F.col(f"more_{values[0]}").isNotNull())
    inner = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"all_{v}": F.sum(v).over(upto) for v in values})
    joined = local.join(totals, ["conv_id", "part"], "left")
    more = {f"all_{v}": F.col(f"all_{v}") + F.coalesce(f"more_{v}", F.lit(0)) for v in values}
    return joined.withColumns(more).drop("part", *[f"more_{v}" for v in values])


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 over the ids of the conversations that end at a node, one row per node.

    Ids of one stretch are joined first. The digest is sequential, so the stretches of a node meet
    in one task, which reads them as a sorted stream and holds one state.
    """
    stretch = F.floor(F.col("conv_id") / IDS).alias("stretch")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    joined = ends.groupBy(*KEY, stretch).agg(ids)
    ranked = joined.repartition(*KEY).sortWithinPartitions(*KEY, "stretch").drop("stretch")
    schema = ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = None, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * (len(KEY) + 1)
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if len(done) >= 1000:
                yield flush()
        if state is not None:
            done.append((*now, state.hexdigest()))
        yield flush()

    return ranked.mapInArrow(run, schema)


def prefix_trie(df: DataFrame, how: Rebuild) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations of `df` (conv_id, turn, role, text).

    `conv_id` is the least member, `parent_conv_id` the parent's (null for the root), `n_convs` the
    members, `n_children` and `n_leaves` the children and the childless nodes below or at the node,
    `saved_tokens` the words of last turns that members share, over the subtree, `ends_sha256` the
    digest of the members that end there.

    Sums over a subtree need no walk of the trie: a node's value is laid at its least member's
    prefix, summed from there along that conversation, and added up over a node's members.
    """
    df = df.select(*[F.col(c).cast(k).alias(c) for c, k in
                     (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))])
    df = df.filter("conv_id IS NOT NULL")
    for salt in range(SALTS):
        if _ambiguous(df, salt):
            continue
        places = cut_lineage(_positions(_turns(df, salt)))
        rows, lengths = _rebuilt(places, how)
        rows = cut_lineage(rows)
        nodes = cut_lineage(_nodes(rows))
        if not _disagreeing(nodes):
            return _measured(rows, lengths, nodes)
    raise RuntimeError(f"no salt of {SALTS} tells all turns and prefixes apart")


def _measured(rows: DataFrame, lengths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The trie's nodes with all their columns."""
    # The parent's fingerprint is the node's without its last turn.
    lanes = [
        f"({q} - {_lane(i, 'low_t1', 'low_t2')} * {_power(i, 'depth')} % {p} + {p}) % {p} AS p{q}"
        for i, (q, p) in enumerate(zip(LANES, PRIMES, strict=True))
    ]
    nodes = nodes.selectExpr("*", *lanes, "depth - 1 AS pdepth")
    parent_key = [f"p{c}" for c in KEY]
    members = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = members.select(
        F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(q) for q in LANES], "n_convs", "conv_id",
        F.lit(0).cast("bigint").alias("words"), *[F.lit(None).cast("bigint").alias(c) for c in parent_key],
    )
    nodes = root.unionByName(nodes.select(*root.columns))
    children = nodes.filter("depth > 0").groupBy(*[F.col(p).alias(c) for p, c in zip(parent_key, KEY, strict=True)])
    nodes = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), list(KEY), "left")
    nodes = cut_lineage(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    values = nodes.select(
        "conv_id",
        "depth",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
    )
    # Every conversation is a member of the root too.
    start = lengths.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in KEY])
    steps = rows.select("conv_id", *KEY).unionByName(start)
    valued = steps.join(values, ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"])
    below = _later_sums(valued, ["saved", "leaf"])
    sums = below.groupBy(*KEY).agg(F.sum("all_saved").alias("saved_tokens"), F.sum("all_leaf").alias("n_leaves"))

    last = lengths.withColumnRenamed("length", "depth").join(steps, ["conv_id", "depth"])
    # A parent meets its children in parts: most of all nodes may have one parent.
    renamed = [F.col(c).alias(p) for c, p in zip(KEY, parent_key, strict=True)]
    parents = nodes.select(*renamed, F.col("conv_id").alias("parent_conv_id"))
    parted = nodes.withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)))
    needed = parted.select(*parent_key, "part").distinct().join(parents, parent_key)
    return (
        parted.join(sums, list(KEY))
        .join(_ends(last), list(KEY), "left")
        .join(needed, [*parent_key, "part"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
