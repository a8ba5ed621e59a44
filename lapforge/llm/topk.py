"""Exact top-k inner products by no-random-access aggregation.

Candidates are read in blocks. A block keeps one list per component, its candidates in order of
that component; a query reads each list from the end that its own sign makes best. After each
stretch every candidate has a lower bound (what was read, plus the least values of its unread
lists) and an upper one (what was read, plus the values that its unread lists have come down to).
The k-th best lower bound, or the k-th best score of earlier blocks if that is more, is the mark to
reach. Reading stops when all but a small part of the candidates have an upper bound below the
mark; the scores of that part are resolved. Equal bounds may still qualify, since ties go to the
smaller id. The first stretch of a query reaches nearly as deep as the one before it needed, so
bounds are seldom looked at in vain.

Queries come in chunks of bounded size, each chunk a broadcast for one job over all candidates;
candidates are never shuffled for a query. A chunk's first marks come from its own members, which
are candidates too, so tasks send on only what can still be among the k best.

Vectors that are null or hold null or non-finite components take no part; shorter vectors end in
zeros. A query's own row is no candidate, another row of the same id is. Equal scores go by id,
null ids last. A row without id is a candidate only. Fewer candidates than k: all of them; no rows: none. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm import vectors
from lapforge.operators.groups import top_n
from lapforge.session import cut_lineage

BLOCK = 4096  # candidates whose lists are kept at a time
CHUNK = 4096  # queries of one job
STRETCH = 24  # a list is read in so many steps at most
SHARE = 16  # reading may stop when one in so many candidates is left over besides the k best
NO_SCORE = np.iinfo(np.int64).min


class SortedLists:
    """The lists of one block of candidates: per component, their places by ascending value.

    Kept both ways round, one line per component and direction, stretch by stretch, so that the
    stretches a query reads lie together; the last one is filled up with a place of no candidate.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, (n, dim) = values, values.shape
        up = np.argsort(values, axis=0, kind="stable")
        worth = np.take_along_axis(values, up, axis=0)
        self.step = max(1, -(-n // STRETCH))
        self.steps = -(-n // self.step)

        def stretched(lines: np.ndarray, fill: np.ndarray) -> np.ndarray:
            both = np.concatenate([lines, lines[:, ::-1]])
            missing = self.steps * self.step - n
            padded = np.concatenate([both, np.broadcast_to(fill[:, None], (2 * dim, missing))], axis=1)
            return np.ascontiguousarray(padded.reshape(2 * dim, self.steps, self.step).transpose(1, 0, 2))

        self.places = stretched(up.T, np.full(2 * dim, n))
        # What fills up the lists repeats their last value, the frontier when all is read.
        ends = np.concatenate([worth[-1:].T, worth[:1].T])[:, 0] if n else np.zeros(2 * dim, np.int64)
        self.worth = stretched(worth.T, ends)
        self.doubles = self.worth.astype(np.float64)
        self.most = int(np.abs(values).max(initial=0))
        self.needed = 1  # stretches that the query before read

    def qualifying(self, query: np.ndarray, mark: int, k: int) -> np.ndarray:
        """Places of the candidates that can reach `mark` and the k best lower bounds of this block."""
        n, few = len(self.values), k + len(self.values) // SHARE
        used = np.flatnonzero(query)
        everyone = np.arange(n)
        if not len(used) or n <= few:
            return everyone if len(used) or mark <= 0 else everyone[:0]
        weight = query[used]
        # All sums are whole numbers and exact: doubles where they hold them (they multiply faster), else longs.
        kind = np.float64 if self.most * int(np.abs(weight).max()) * len(used) < 1 << 52 else np.int64
        values, weight = self.doubles if kind is np.float64 else self.worth, weight.astype(kind)
        line = used + len(query) * (weight > 0)
        least = values[-1, line, -1] * weight
        first = stop = min(self.needed, self.steps)
        while True:
            places = self.places[:stop].take(line, axis=1)
            worth = values[:stop].take(line, axis=1)
            worth *= weight[None, :, None]
            reached = worth[-1, :, -1].copy()
            # A candidate was met in some lists; the others can add what they have come down to, or their least.
            lower = self._summed(places, worth - least[None, :, None]) + least.sum()
            worth -= reached[None, :, None]
            upper = self._summed(places, worth) + reached.sum()
            goal = max(mark, np.partition(lower, n - k)[n - k])
            open_ = np.flatnonzero(upper >= goal)
            if len(open_) <= few or stop == self.steps:
                # The next query starts a stretch earlier if this one read more than it had to.
                self.needed = max(1, stop - (stop == first and 3 * len(open_) < few))
                return open_
            stop += 1

    def _summed(self, places: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """The sum of the values read at each candidate."""
        n = len(self.values)
        if worth.dtype == np.float64:
            return np.bincount(places.ravel(), worth.ravel(), n + 1)[:n]
        out = np.zeros(n + 1, np.int64)
        np.add.at(out, places.ravel(), worth.ravel())
        return out[:n]


class Best:
    """The k best (score, id, row) of each query so far."""

    def __init__(self, queries: int, k: int, marks: np.ndarray) -> None:
        self.k, self.marks = k, marks.copy()
        self.kept = [np.zeros((0, 3), np.int64) for _ in range(queries)]

    def add(self, q: int, found: np.ndarray) -> None:
        """Take in lines of (score, id, row); keeps the k best and raises the mark to reach."""
        found = found[found[:, 0] >= self.marks[q]]
        if not len(found):
            return
        lines = np.concatenate([self.kept[q], found])
        lines = lines[np.lexsort((lines[:, 2], lines[:, 1], -lines[:, 0]))][: self.k]
        self.kept[q] = lines
        if len(lines) == self.k:
            self.marks[q] = max(self.marks[q], lines[-1, 0])

    def rows(self, keys: np.ndarray) -> pa.RecordBatch:
        query = np.repeat(keys, [len(x) for x in self.kept])
        lines = np.concatenate([np.zeros((0, 3), np.int64), *self.kept])
        arrays = [pa.array(query), *(pa.array(lines[:, i]) for i in (2, 1, 0))]
        return pa.RecordBatch.from_arrays(arrays, names=["query", "row", "id", "score"])


def _search(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], keys: np.ndarray, queries: np.ndarray, k: int, marks: np.ndarray) -> Best:
    """The k best candidates of each query over blocks of (rows, ids, vectors)."""
    best = Best(len(keys), k, marks)
    for rows, ids, values in blocks:
        lists = SortedLists(values)
        where = dict(zip(rows.tolist(), range(len(rows)), strict=True))
        for q, query in enumerate(queries):
            own = where.get(int(keys[q]), -1)
            # The own row may take a place among the k best lower bounds, so one more is asked for.
            places = lists.qualifying(query, int(best.marks[q]), k + 1)
            places = places[places != own]
            score = values[places] @ query
            best.add(q, np.stack([score, ids[places], rows[places]], axis=1))
    return best


NULL_ID = np.iinfo(np.int64).max
SCHEMA = "query_id long, rank int, vec_id long, score long"


def top_products(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k greatest inner products of every row where `is_query` (over the id column) with all other rows.

    Vectors are taken as whole numbers, floor(1024 * component).
    """
    spark = df.sparkSession
    picked = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector).alias("v")
    )
    # The row number tells repeated rows apart; written once, it stays what it is.
    width = 2 * spark.sparkContext.defaultParallelism
    table = vectors.whole(picked, "v").repartition(width).withColumn("row", F.monotonically_increasing_id())
    table = cut_lineage(table)
    shape = table.agg(
        F.max(F.size("v")).alias("width"), F.max(vectors.greatest("v")).alias("most"), F.count_if("q").alias("n")
    ).first()
    if not shape.n:
        return spark.createDataFrame([], SCHEMA)
    vectors.fits(shape.most, shape.width)
    chunks = -(-shape.n // CHUNK)
    found = None
    for chunk in range(chunks):
        mine = table.filter("q").filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk)
        one = _chunk_found(table, mine, shape.width, k)
        found = one if found is None else found.unionByName(one)
    names = table.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    ranked = top_n(found, ["query"], [F.col("score").desc(), F.col("id"), F.col("row")], k, rank="rank")
    vec_id = F.when(F.col("id") != NULL_ID, F.col("id")).alias("vec_id")
    return ranked.join(names, "query").select("query_id", "rank", vec_id, "score")


def _chunk_found(table: DataFrame, mine: DataFrame, width: int, k: int) -> DataFrame:
    """What tasks find for one chunk of queries: (query, row, id, score), at most k rows per query and task."""
    columns = ("row", F.coalesce("id", F.lit(NULL_ID)).alias("id"), "v")
    mine = mine.select(*columns)
    local = mine.collect()
    keys, ids = (np.array([r[i] for r in local], np.int64) for i in (0, 1))
    queries = vectors.padded([r.v for r in local], width)
    sent = mine.sparkSession.sparkContext.broadcast((keys, ids, queries))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best score of each query among the chunk's own rows: a first mark."""
        chunk = sent.value
        for batch in batches:
            some = np.asarray(batch.column(0), np.int64)
            whole = ([x[a : a + BLOCK] for x in chunk] for a in range(0, len(chunk[0]), BLOCK))
            unmarked = np.full(len(some), NO_SCORE)
            best = _search(whole, some, vectors.matrix(batch.column(2), width), k, unmarked)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best.marks)], names=["row", "mark"])

    spread = mine.repartition(mine.sparkSession.sparkContext.defaultParallelism)
    marked = spread.mapInArrow(start, "row long, mark long").collect()
    marks = dict(map(tuple, marked))
    first = np.array([marks[row] for row in keys.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, queries = sent.value

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    rows, ids = (np.asarray(part.column(i), np.int64) for i in (0, 1))
                    yield rows, ids, vectors.matrix(part.column(2), width)

        yield _search(blocks(), keys, queries, k, first).rows(keys)

    found = cut_lineage(table.select(*columns).mapInArrow(run, "query long, row long, id long, score long"))
    sent.destroy()
    return found
