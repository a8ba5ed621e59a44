"""Product codes of vectors, with entries found by equal-average search.

A vector is cut into equal parts; each part position has a codebook, refined by rounds of
assignment and averaging over all vectors. The nearest entry of a part is searched among entries
in order of their component sums, outwards from the part's own sum: by Cauchy-Schwarz the squared
distance is at least (gap of sums)^2 / dimension, so a side is done once that strictly exceeds the
best distance. Equal distances go to the lower index, so an entry whose bound equals the best
distance is still looked at.

Spark assigns the parts in Arrow batches and adds up entry sums by task, then over tasks. Only the
codebooks (entries x dimension numbers) pass through the driver, whatever the number of vectors.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors end in
zeros up to the longest one's length, rounded up to a multiple of the number of parts. Starting
entries go by id, null ids last, equal ids by vector; repeated rows are rows of their own. With
fewer vectors than entries the codebooks are that much smaller. No vectors: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm import vectors
from lapforge.session import cut_lineage

ROWS = 2048  # vectors looked at together
RUN = 8  # entries looked at together on one side


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row, by equal-average search."""
    n, dim = rows.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sorted_sums, sorted_entries = sums[order], entries[order]
    own = rows.sum(axis=1)
    right = np.searchsorted(sorted_sums, own)  # next entry to look at on each side
    left = right - 1
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, len(entries))
    last = len(entries) - 1

    def look(who: np.ndarray, at: np.ndarray) -> None:
        """Compare rows `who` with the entries at places `at`, one line of places per row."""
        inside = (at >= 0) & (at <= last)
        safe = np.clip(at, 0, last)
        gap = rows[who, None, :] - sorted_entries[safe]
        distance = np.where(inside, np.einsum("ijk,ijk->ij", gap, gap), np.iinfo(np.int64).max)
        code = order[safe]
        near = distance.min(axis=1)
        chosen = np.where(distance == near[:, None], code, len(entries)).min(axis=1)
        better = (near < best[who]) | ((near == best[who]) & (chosen < index[who]))
        best[who[better]], index[who[better]] = near[better], chosen[better]

    def still(who: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows whose next entry on a side exists and is not ruled out by its sum."""
        inside = (at[who] >= 0) & (at[who] <= last)
        who = who[inside]
        gap = own[who] - sorted_sums[at[who]]
        # A side is done at gap^2 / dim > best; rounded up, the quotient says so in whole numbers.
        return who[-(-gap * gap // max(dim, 1)) <= best[who]]

    step = np.arange(RUN)
    to_right = to_left = np.arange(n)
    while len(to_right) or len(to_left):
        to_right = still(to_right, right)
        look(to_right, right[to_right, None] + step)
        right[to_right] += RUN
        to_left = still(to_left, left)
        look(to_left, left[to_left, None] - step)
        left[to_left] -= RUN
    return index, best


def assigned(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the parts of each row; `books` is parts x entries x dimension."""
    parts, _, dim = books.shape
    found = [nearest(values[:, p * dim : (p + 1) * dim], books[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _refined(rows: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entry means, rounded down; unused entries stay."""
    parts, entries, dim = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for block in _blocks(batches):
            values = vectors.matrix(block.column(0), parts * dim)
            codes, _ = assigned(values, books)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], values[:, p * dim : (p + 1) * dim])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        arrays = [pa.array(part), pa.array(entry), pa.array(counts[part, entry])]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=names)

    names = ["part", "entry", "n", "total"]
    found = rows.select(vector).mapInArrow(run, "part long, entry long, n long, total array<long>")
    # One row per part, entry and component: no more than the codebooks hold, whatever the data.
    summed = (
        found.select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    books = books.copy()
    part, entry, place, n, total = (np.asarray(c, np.int64) for c in summed.toArrow().columns)
    books[part, entry, place] = total // n
    return books


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def product_codes(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> DataFrame:
    """One row per usable vector: its code (two hex digits per part), squared error, the error of
    all vectors of its label (nulls together), and the digest of the codebooks. At most 256 entries."""
    spark = df.sparkSession
    picked = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = cut_lineage(vectors.whole(picked, "v"))
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(vectors.greatest("v")).alias("most")).first()
    if shape.width is None:
        return spark.createDataFrame([], SCHEMA)
    dim = -(-shape.width // parts)
    vectors.fits(2 * shape.most * max(dim, 1), parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = vectors.padded([r.v for r in first], parts * dim)
    books = start.reshape(len(first), parts, dim).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _refined(rows, "v", books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes, errors = assigned(vectors.matrix(block.column(1), parts * dim), books)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            arrays = [block.column(0), block.column(2), pa.array(text), pa.array(errors.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = cut_lineage(rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"))
    # A label that most rows share meets its sum in parts.
    coded = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(64)))
    totals = coded.groupBy("label", "part").agg(F.sum("error").alias("error"))
    whole = totals.groupBy("label").agg(F.sum("error").alias("label_error"), F.collect_set("part").alias("parts"))
    whole = whole.select(F.col("label").alias("__label"), "label_error", F.explode("parts").alias("__part"))
    same = coded["label"].eqNullSafe(whole["__label"]) & (coded["part"] == whole["__part"])
    return coded.join(whole, same).select(
        "vec_id", "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256")
    )
