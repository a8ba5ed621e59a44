"""Document quality by a regularised quadratic discriminant.

Every text gives a few statistics, transformed so that each class is roughly normal. Each
class has its mean and a covariance shrunk towards the pooled variances; a text's score is the
logistic of the difference of its two log densities (Mahalanobis distance by the cached
Cholesky factor, plus log determinant) and log priors.

Statistics come from one narrow pass over the whole texts and are written once; means and
covariances are sums over all labelled rows with map-side combine; the driver sees only these
sums, whatever the corpus.

Defined results: a null or empty text has statistics of its own (all counts 0) and a score; a
class with fewer than two labelled rows, or none, makes every score the share of class 1 (0.5
without labels); rows with a null label or id are not learnt from; repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.llm.arrow import with_columns
from lapforge.llm.words import PIECE_BYTES, SPACED, distinct_per_row, row_sums, text_bytes, word_hashes, word_spans
from lapforge.session import cut_lineage

# Statistics of a text, in this order: shares of characters unless said otherwise.
STATISTICS = (
    "characters (log)", "upper case of letters", "digits", "sentence marks", "exclamations", "pipes", "other symbols",
    "spaces", "line ends", "beyond ASCII", "mean word length (log)", "distinct of words", "words as the one before",
    "words that end in a symbol", "characters a line (log)", "distinct of word pairs",
)
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = 1 if _b & 0xC0 != 0x80 else 0  # first byte of a longer character
    elif _c.isupper():
        _CLASS[_b] = 2
    elif _c.islower():
        _CLASS[_b] = 3
    elif _c.isdigit():
        _CLASS[_b] = 4
    elif _c in ".,;:?'\"-()":
        _CLASS[_b] = 5
    elif _c == "!":
        _CLASS[_b] = 6
    elif _c == "|":
        _CLASS[_b] = 7
    elif _c in "\n\r":
        _CLASS[_b] = 9
    elif _c.isspace():
        _CLASS[_b] = 8
    else:
        _CLASS[_b] = 10


def statistics(column: pa.Array) -> np.ndarray:
    """The STATISTICS of each text of a column, a row each."""
    data, offsets = text_bytes(column)
    kinds = _CLASS[data]
    n = len(offsets) - 1
    count = np.zeros((n, 11))
    for at in range(0, len(kinds), PIECE_BYTES):
        # The rows that a stretch of the bytes touches, and how far each reaches into it.
        stop = min(at + PIECE_BYTES, len(kinds))
        low, high = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, stop, "left")
        held = np.diff(np.clip(offsets[low : high + 1], at, stop))
        place = np.repeat(np.arange(high - low), held) * 11 + kinds[at:stop]
        count[low:high] += np.bincount(place, minlength=(high - low) * 11).reshape(-1, 11)
    chars = count[:, 1:].sum(1)  # kind 0 is for bytes inside a character
    some = np.maximum(chars, 1)
    _, starts, ends, rows = word_spans(data, offsets, SPACED)
    words = np.diff(rows).astype(float)
    any_words = np.maximum(words, 1)
    hashes, _ = word_hashes(data, offsets, SPACED)
    distinct = np.diff(distinct_per_row(hashes, rows)[1])
    again = np.zeros(len(hashes), np.int64)
    pair = hashes.copy()
    if len(hashes):
        first = np.zeros(len(hashes), bool)
        first[rows[:-1][rows[:-1] < len(hashes)]] = True
        again[1:] = (hashes[1:] == hashes[:-1]) & ~first[1:]
        pair[1:] = np.where(first[1:], hashes[1:], hashes[1:] * np.uint64(31) + hashes[:-1])
    pairs = np.diff(distinct_per_row(pair, rows)[1])
    marked = np.isin(kinds[ends - 1], (6, 7, 10)).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    letters = np.maximum(count[:, 2] + count[:, 3], 1)
    lines = count[:, 9] + 1
    share = lambda x: np.sqrt(x / some)
    return np.column_stack(
        [
            np.log1p(chars),
            np.sqrt(count[:, 2] / letters),
            *(share(count[:, k]) for k in (4, 5, 6, 7, 10, 8, 9)),
            share(count[:, 1]),
            np.log1p(row_sums(ends - starts, rows) / any_words),
            distinct / any_words,
            np.sqrt(row_sums(again, rows) / any_words),
            np.sqrt(row_sums(marked, rows) / any_words),
            np.log1p(chars / lines),
            pairs / any_words,
        ]
    )


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics", keep: list[str] | None = None) -> DataFrame:
    """Add the STATISTICS of every whole text as an array."""
    kind = T.ArrayType(T.DoubleType(), False)

    def prepare():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            values = statistics(piece.column(text))
            rows = np.arange(len(values) + 1) * len(STATISTICS)
            arrow = pa.list_(pa.field("element", pa.float64(), False))
            return [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values.ravel()), type=arrow)]

        return make

    return with_columns(df, text, [T.StructField(name, kind)], prepare, keep)


@dataclass(frozen=True)
class Discriminant:
    """Prior of class 1 and, where both classes are known, each one's mean, inverse Cholesky factor
    of the covariance and log determinant."""

    prior: float
    means: tuple = ()
    factors: tuple = ()
    log_dets: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if not self.means:
            return np.full(len(x), self.prior)
        density = [
            -0.5 * ((np.einsum("ij,kj->ik", x - m, f) ** 2).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)
        ]
        gap = density[1] - density[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fitted(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1) -> Discriminant:
    """The discriminant from (rows, sums, sums of products) of class 0 and 1."""
    rows = {k: moments[k][0] for k in moments}
    total = sum(rows.values())
    if any(rows.get(k, 0) < 2 for k in (0, 1)):
        return Discriminant(rows.get(1, 0) / total if total else 0.5)
    means, spread = [], []
    for k in (0, 1):
        n, sums, products = moments[k]
        mean = sums / n
        means.append(mean)
        spread.append(products / n - np.outer(mean, mean))
    pooled = np.diag(sum(rows[k] * np.diag(spread[k]) for k in (0, 1)) / total + 1e-6)
    factors, log_dets = [], []
    for s in spread:
        lower = np.linalg.cholesky((1 - shrink) * s + shrink * pooled)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(rows[1] / total, tuple(means), tuple(factors), tuple(log_dets))


def moments(labelled: DataFrame, name: str = "statistics", label: str = "label") -> dict[int, tuple]:
    """(rows, sums, sums of products) of each class, summed by Spark with map-side combine."""
    width = len(STATISTICS)
    x = [F.get(name, F.lit(i)) for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(width)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for row in labelled.groupBy(F.col(label).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        square = np.zeros((width, width))
        for i, j in pairs:
            square[i, j] = square[j, i] = row[f"p{i}_{j}"]
        out[row["k"]] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(width)]), square)
    return out


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    learn: Column,
    text: str = "text",
    id_: str = "doc_id",
    shrink: float = 0.1,
) -> DataFrame:
    """(`id_`, `score`) of every row: the probability that `label` is 1.

    `labels` holds `id_` and the columns of `label`; only documents for which `learn` (over
    the ids) holds are learnt from. Nothing but the text enters a score.
    """
    stats = cut_lineage(with_statistics(docs.select(id_, text), text, "statistics", [id_]))
    marks = labels.select(F.col(id_), label.alias("label")).filter(F.col("label").isin(0, 1) & learn)
    model = fitted(moments(stats.join(marks, id_)), shrink)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], names=[id_, "score"])

    schema = T.StructType([docs.schema[id_], T.StructField("score", T.DoubleType())])
    return stats.select(id_, "statistics").mapInArrow(run, schema)
