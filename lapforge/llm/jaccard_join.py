"""Similarity classes by an exact Jaccard join over word shingles, with adaptive multi-match prefixes.

Order the shingles of every text by one global order, rare before frequent. Texts of n
shingles that may link share at least need = ceil(t n) of them, so their first n - need + l
shingles (the l-prefix) share at least l. A longer prefix costs more postings but asks more
shared shingles of a candidate: each text takes the l of least estimated cost, and a pair must
share the smaller l of its two. Nothing that links is missed, whatever the estimates.

1. Shingle counts go into a sketch of fixed size (2^22 cells); cells that stand out of the
   noise rank their shingles as frequent. The ranks, 4 MB, are sent to all tasks.
2. Texts with equal sets are one class from here on.
3. Each prefix shingle first links all that hold it to one of them, its hub: as many
   candidates as postings, however large a group of near copies is. The hub is the text in
   which the shingle comes first: rarer ones before it are mostly edits, so it is the least
   edited. Candidates are verified on their full sets and connected.
4. Only postings of different components under one shingle are then paired, filtered by
   length, place in the prefix and number of shared shingles, verified, and connected with the
   rest. Near copies that link are one component by then and yield no pairs.

Defined results: null, empty and wordless texts have no shingles and link with nothing; a
text of fewer words than a shingle has its whole sequence as one; rows that share an id share
its class; repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lapforge.llm.arrow import with_columns
from lapforge.llm.words import SPACED, mix, pieces, row_sums, shingles, text_bytes, word_hashes
from lapforge.session import cut_lineage

CELL_BITS, CHUNK = 22, 4096
MOST_MATCHES = 4  # longest prefix extension that is considered
NOISE = 4.0  # standard deviations from which a cell counts as frequent
BROADCAST_ROWS = 500_000  # ids of texts to verify up to which they are sent to all tasks


def _shingled(piece: pa.RecordBatch, column: str, size: int):
    words, rows = word_hashes(*text_bytes(piece.column(column)), SPACED)
    return shingles(words, rows, size)


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(`chunk`, `counts`): occurrences of shingles per cell of the sketch, over all texts, in
    stretches of `CHUNK` cells; stretches without any are left out."""
    schema = "chunk int, counts binary"

    def sent(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for piece in pieces(batch, text):
                np.add.at(counts, _cells(_shingled(piece, text, size)[0]), 1)
        chunks = counts.reshape(-1, CHUNK)
        yield sent({int(i): chunks[i] for i in np.flatnonzero(chunks.any(1))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield sent(totals)

    return docs.select(text).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)


def usual_count(counts: DataFrame) -> float:
    """The median count of all cells. The driver gets a row for each different count, not the cells."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in batch.column("counts"):
                found = np.unique(np.frombuffer(cells.as_buffer(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["value", "n"])

    tallies = counts.mapInArrow(tally, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    left_out = (1 << CELL_BITS) - sum(row["n"] for row in tallies)
    known = sorted([(0, left_out), *((row["value"], row["n"]) for row in tallies)])
    upto = np.cumsum([n for _, n in known])
    half = 1 << CELL_BITS - 1
    return sum(known[int(np.searchsorted(upto, place, "right"))][0] for place in (half - 1, half)) / 2


class Order:
    """The global order of shingles: frequency rank of the cell first, then the hash."""

    def __init__(self, counts: DataFrame, documents: int):
        # A few frequent shingles do not move the median; noise is that of a random dealing.
        usual = usual_count(counts)
        self.noise = noise = max(usual, 1.0) ** 0.5

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, cells in zip(batch.column("chunk"), batch.column("counts"), strict=True):
                    above = np.maximum(np.frombuffer(cells.as_buffer(), np.int64).astype(np.float32) - usual, 0)
                    rank = 1 + np.log2(np.maximum(above, 1)).astype(np.uint8)
                    rank = np.where(above > NOISE * noise, rank, 0).astype(np.uint8)
                    if rank.any():
                        arrays = [pa.array([chunk.as_py()], pa.int32()), pa.array([rank.tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "ranks"])

        # Ranks are made in the tasks: of a cell one byte reaches the driver, and none of a stretch without rank.
        self.rank = np.zeros(1 << CELL_BITS, np.uint8)
        for row in counts.mapInArrow(ranked, "chunk int, ranks binary").toLocalIterator():
            self.rank[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["ranks"], np.uint8)
        self.documents = max(documents, 1)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """Numbers in the global order; 58 bits of the hash tell shingles of a rank apart."""
        rank = self.rank[_cells(values)].astype(np.uint64)
        return rank << np.uint64(58) | mix(values) >> np.uint64(6)

    def expected(self, keys: np.ndarray) -> np.ndarray:
        """Estimated number of texts with each shingle; no less than the noise lets through."""
        rank = (keys >> np.uint64(58)).astype(np.float64)
        return np.where(rank > 0, 2.0**rank, self.noise)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a text of n shares at least with any text that it links to."""
    return -(-percent * n // 100)


def prefix_matches(keys: np.ndarray, rows: np.ndarray, percent: int, order: Order) -> np.ndarray:
    """The l of least estimated cost for each row of ascending keys.

    With f the expected postings of the prefix, scanning costs f. Were texts independent, a
    share f / N of them would hold a shingle of it, so N (f / N)^l / l! share l of them; each
    such candidate costs the text's length.
    """
    n = np.diff(rows)
    total = np.concatenate([[0.0], np.cumsum(order.expected(keys))])
    best, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    factorial = 1.0
    for matches in range(1, MOST_MATCHES + 1):
        factorial *= matches
        length = n - need(n, percent) + matches
        fits = (matches <= need(n, percent)) & (n > 0)
        postings = total[rows[:-1] + np.where(fits, length, 0)] - total[rows[:-1]]
        candidates = order.documents * (postings / order.documents) ** matches / factorial
        now = np.where(fits, postings + n * candidates, np.inf)
        best = np.where(now < cost, matches, best)
        cost = np.minimum(now, cost)
    return best


def _distinct(values: np.ndarray, rows: np.ndarray):
    """Ascending distinct values of each row and their offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    sort = np.lexsort((values, row))
    values, row = values[sort], row[sort]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    row = row[keep]
    return values[keep], np.searchsorted(row, np.arange(len(rows)))


def _set_ids(keys: np.ndarray, rows: np.ndarray) -> pa.Array:
    """128-bit ids of the sets of keys; null for empty ones."""
    halves = [row_sums(mix(keys ^ salt), rows) for salt in (np.uint64(0x51ED270B27), np.uint64(0xC2B2AE3D27D4EB4F))]
    both = np.stack(halves, 1).astype("<u8")
    ids = [b.tobytes() if n else None for b, n in zip(both, np.diff(rows), strict=True)]
    return pa.array(ids, pa.binary())


def prefixed(docs: DataFrame, order, size: int, percent: int, text: str, keep: list[str]) -> DataFrame:
    """Add `n_shingles`, `set` (its id), `matches` (l) and `prefix` (the l-prefix's keys)."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set", T.BinaryType()),
        T.StructField("matches", T.IntegerType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ]

    def prepare():
        known = order.value

        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            values, rows = _shingled(piece, text, size)
            keys, rows = _distinct(known.keys(values), rows)
            n = np.diff(rows)
            matches = prefix_matches(keys, rows, percent, known)
            length = np.where(n > 0, n - need(n, percent) + matches, 0)
            offsets = np.concatenate([[0], np.cumsum(length)])
            at = np.arange(offsets[-1]) + np.repeat(rows[:-1] - offsets[:-1], length)
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[at].view(np.int64), pa.int64()))
            return [pa.array(n, pa.int64()), _set_ids(keys, rows), pa.array(matches, pa.int32()), prefix]

        return make

    return with_columns(docs, text, fields, prepare, keep)


def full_sets(docs: DataFrame, order, size: int, text: str) -> DataFrame:
    """(`set`, `keys`): the whole shingle sets of the texts."""
    fields = [T.StructField("set", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]

    def prepare():
        known = order.value

        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            values, rows = _shingled(piece, text, size)
            keys, rows = _distinct(known.keys(values), rows)
            listed = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(keys.view(np.int64), pa.int64()))
            return [_set_ids(keys, rows), listed]

        return make

    return with_columns(docs, text, fields, prepare, keep=[])


def _near_enough(x: str, y: str, percent: int) -> Column:
    """Whether a shared shingle of postings `x` and `y` (struct or alias) counts for the pair.

    The lengths must allow a link. A pair that links shares at least `both` = ceil(t / (1 + t)
    (n + n')) shingles, so of the m that it must share in its prefixes, each lies among the
    first n - both + m of either text. What comes before a shared shingle in one text and is in
    the other is in the other's prefix too, so the `lone` shingles before it, in no other prefix,
    are not shared: what else comes before it in both, and what comes after, must reach `both`.
    """
    n, other = F.col(f"{x}.n"), F.col(f"{y}.n")
    both = F.ceil((n + other) * percent / (100 + percent))
    m = F.least(f"{x}.matches", f"{y}.matches")
    long_enough = F.least(n, other) * 100 >= F.greatest(n, other) * percent
    near = (F.col(f"{x}.pos") < n - both + m) & (F.col(f"{y}.pos") < other - both + m)
    before = F.least(*[F.col(f"{side}.pos") - F.col(f"{side}.lone") for side in (x, y)])
    after = F.least(n - F.col(f"{x}.pos"), other - F.col(f"{y}.pos"))
    return long_enough & near & (before + after >= both)


def components(edges: DataFrame) -> DataFrame:
    """(`node`, `comp`): the least node that each node of the edges (a, b) can reach.

    Every round a node takes the least label around it, then the label of its label, until no
    label changes: few rounds even for long chains.
    """
    both = cut_lineage(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(edges.select("b", "a"))
        .distinct()
    )
    labels = cut_lineage(
        both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("comp"))
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("near")), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        lower = labels.join(around, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = cut_lineage(
            lower.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next"))
        )
        if moved.filter("comp <> next").isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("comp"))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, order, size: int, percent: int, text: str, id_: str) -> DataFrame:
    """The candidate pairs (a, b) of set numbers whose full sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "set", "rep"), "sid")
    wanted = cut_lineage(wanted)
    ids = wanted.select(F.col("rep").alias(id_)).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(id_, text).join(ids, docs[id_].eqNullSafe(ids[id_]), "left_semi").select(text)
    full = full_sets(texts, order, size, text).join(wanted.select("sid", "set"), "set").dropDuplicates(["sid"])
    full = cut_lineage(full.select("sid", "keys"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.select("a", "b")
        .join(full.select(F.col("sid").alias("a"), F.col("keys").alias("x")), "a")
        .join(full.select(F.col("sid").alias("b"), F.col("keys").alias("y")), "b")
        .filter(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent)
        .select("a", "b")
    )


def similarity_classes(
    docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id_: str = "doc_id"
) -> DataFrame:
    """(`id_`, `n_shingles`, `component_id`) of every row: texts are linked if the intersection of
    their sets of `size`-word shingles is at least `percent` / 100 of the union; `component_id`
    is the least id that links reach."""
    docs = docs.select(id_, text)
    context = docs.sparkSession.sparkContext
    counts = cut_lineage(cell_counts(docs, size, text))
    order = context.broadcast(Order(counts, docs.count()))
    rows = cut_lineage(prefixed(docs, order, size, percent, text, [id_]))
    sets = (
        rows.filter("set IS NOT NULL")
        .groupBy("set")
        .agg(F.min(id_).alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "matches", "prefix")])
        .withColumn("sid", F.monotonically_increasing_id())
    )
    sets = cut_lineage(sets)
    postings = sets.select("sid", F.col("n_shingles").alias("n"), "matches", F.posexplode("prefix").alias("pos", "key"))
    repeated = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    place = Window.partitionBy("sid").orderBy("pos")  # at most a prefix
    shared = postings.join(repeated, "key").withColumn("lone", F.col("pos") + 1 - F.row_number().over(place))
    shared = cut_lineage(shared)
    hubs = shared.groupBy("key").agg(F.min(F.struct("pos", "n", "sid", "matches", "lone")).alias("hub"))
    starred = cut_lineage(
        shared.join(hubs, "key")
        .withColumn("own", F.struct("n", "matches", "pos", "lone"))
        .filter((F.col("sid") != F.col("hub.sid")) & _near_enough("own", "hub", percent))
        .groupBy(F.col("hub.sid").alias("a"), F.col("sid").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.least("matches", "hub.matches")).alias("m"))
        .filter("c >= m")
        .select("a", "b")
    )
    links = cut_lineage(_verified(starred, sets, docs, order, size, percent, text, id_))
    joined = components(links)
    parted = shared.join(joined.withColumnRenamed("node", "sid"), "sid", "left").select(
        "key", "sid", "n", "matches", "pos", "lone", F.coalesce("comp", "sid").alias("comp")
    )
    mixed = parted.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = cut_lineage(parted.join(mixed, "key"))
    left, right = open_.alias("l"), open_.alias("r")
    cross = (
        left.join(
            right,
            (F.col("l.key") == F.col("r.key"))
            & (F.col("l.sid") < F.col("r.sid"))
            & (F.col("l.comp") != F.col("r.comp"))
            & _near_enough("l", "r", percent),
        )
        .groupBy(F.col("l.sid").alias("a"), F.col("r.sid").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.least("l.matches", "r.matches")).alias("m"))
        .filter("c >= m")
        .select("a", "b")
    )
    tried = starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cut_lineage(cross.join(tried, ["a", "b"], "left_anti"))
    if not cross.isEmpty():
        more = _verified(cross, sets, docs, order, size, percent, text, id_)
        joined = components(links.union(more))
    classes = sets.select("sid", "set", "rep").join(joined.withColumnRenamed("node", "sid"), "sid", "left")
    classes = classes.withColumn("comp", F.coalesce("comp", "sid"))
    least = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = classes.join(least, "comp").select("set", "component_id")
    return rows.join(known, "set", "left").select(
        id_, "n_shingles", F.coalesce("component_id", F.col(id_)).alias("component_id")
    )
