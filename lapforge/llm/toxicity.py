"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has grades 0 (none) to GRADES - 1. One weight vector is shared by all ordered
thresholds: P(grade <= k) = logistic(threshold_k - w x), and a text's severity is its expected
grade, the sum of P(grade > k). Features are log counts of the words that speak for toxicity.

The model is fitted on at most `sample` labelled documents, those of least id hash and one text
for each id (that of least hash, where copies of an id differ); words are chosen and counted by
Spark, and every word of the sample that passes the thresholds is a feature. The driver sees the
sample's counts of these words. Labels only say toxic or not, so toxic rows are graded by how many
of the chosen words they hold, cut at the terciles. Scoring is one narrow pass over all whole texts
with the model, whose size is bounded by the sample.

Words are chosen by their share of toxic rows among all that hold them and by the number of
different words before them: a word that occurs in copies of one toxic text only always has the
same word before it, and tells nothing.

Defined results: a null or empty text has no features and the severity of a plain text; without
toxic labels every severity is 0; rows with a null label or id are not learnt from; repeated
rows stay; an empty table gives an empty table; other columns are carried along, except one
named like the result, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.llm.arrow import with_columns
from lapforge.llm.words import ALNUM, distinct_per_row, text_bytes, word_hashes
from lapforge.operators.groups import top_n
from lapforge.session import cut_lineage

GRADES = 4
SAMPLE = 12_000
REJECT = 0.3  # expected grade from which a document counts as toxic


def _members(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places among `hashes`, places in the sorted vocabulary) of the words that are features."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == hashes)
    return known, at[known]


def feature_counts(column: pa.Array, vocabulary: np.ndarray):
    """(rows, features, counts) of a column of texts: the nonzero entries of its count matrix."""
    hashes, rows = word_hashes(*text_bytes(column), ALNUM)
    known, feature = _members(hashes, vocabulary)
    row = np.searchsorted(rows, known, "right") - 1
    both, counts = np.unique(row * max(len(vocabulary), 1) + feature, return_counts=True)
    return both // max(len(vocabulary), 1), both % max(len(vocabulary), 1), counts


@dataclass(frozen=True)
class Ordinal:
    """Weights of the vocabulary's words (sorted hashes) and the ordered thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, column: pa.Array) -> np.ndarray:
        """Expected grade of each text."""
        if not len(self.thresholds):
            return np.zeros(len(column))
        row, feature, count = feature_counts(column, self.vocabulary)
        link = np.bincount(row, np.log1p(count) * self.weights[feature], minlength=len(column))
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - link[:, None], -500, 500)))).sum(1)


def fitted_ordinal(rows, features, values, grades, n_features: int, ridge: float = 0.2, steps: int = 400):
    """(weights, thresholds) of the cumulative-link model by gradient steps (Adam) on the penalised
    mean log likelihood. Thresholds are the first and positive gaps, so they stay in order."""
    n = len(grades)
    share = np.clip([(grades <= k).mean() for k in range(GRADES - 1)], 1e-4, 1 - 1e-4)
    start = np.log(share) - np.log1p(-share)
    parameters = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w, gaps = parameters[:n_features], np.exp(parameters[n_features + 1 :])
        cuts = np.concatenate([[-np.inf], parameters[n_features] + np.append(0, np.cumsum(gaps)), [np.inf]])
        link = np.bincount(rows, values * w[features], minlength=n)
        upper, lower = sigmoid(cuts[grades + 1] - link), sigmoid(cuts[grades] - link)
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        d_link = -(d_upper - d_lower) / n
        d_cuts = (np.bincount(grades, d_upper, GRADES)[:-1] - np.bincount(grades, d_lower, GRADES)[1:]) / n
        d_w = np.bincount(features, values * d_link[rows], minlength=n_features) - ridge * w / n
        tail = np.cumsum(d_cuts[::-1])[::-1]
        gradient = np.concatenate([d_w, tail[:1], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * (1 - step / (steps + 1)) + 0.01
        parameters = parameters + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(parameters[n_features + 1 :])
    return parameters[:n_features], parameters[n_features] + np.append(0, np.cumsum(gaps))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
    least: int = 5,
    share: float = 0.6,
) -> Ordinal:
    """Fit on the labelled documents; a feature needs `least` toxic rows and as many words before
    it, and a `share` of toxic rows among the rows that hold it."""
    spark = docs.sparkSession
    marks = (
        labels.select(F.col(id_).alias("__id"), F.col(label).cast("int").alias("__toxic"))
        .filter(F.col("__toxic").isin(0, 1) & F.col("__id").isNotNull())
        .orderBy(F.xxhash64("__id"), "__id", "__toxic")
        .limit(sample)
    )
    picked = docs.select(F.col(id_).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(marks), "__id")
    # One text for each id, cut before the shuffle too, so copies of an id cannot swell the sample.
    first = top_n(picked.withColumn("__h", F.xxhash64("__t")), ["__id"], [F.col("__h"), F.col("__t"), F.col("__toxic")], 1)
    picked = cut_lineage(first.drop("__h").dropDuplicates(["__t"]))
    fields = [
        T.StructField(
            "words", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("before", T.LongType())]))
        )
    ]

    def prepare():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            hashes, rows = word_hashes(*text_bytes(piece.column("__t")), ALNUM)
            before = np.append(np.zeros(1, np.uint64), hashes[:-1]) if len(hashes) else hashes
            pairs = pa.StructArray.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(before.view(np.int64))], names=["word", "before"]
            )
            return [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pairs)]

        return make

    # Different words before a word count in toxic rows only; all rows count a word once.
    toxic = with_columns(picked.filter("__toxic = 1"), "__t", fields, prepare, []).select(F.inline("words"))
    wide = toxic.groupBy("word").agg(F.count_distinct("before").alias("contexts")).filter(F.col("contexts") >= least)

    distinct_field = [T.StructField("words", T.ArrayType(T.LongType()))]

    def prepare_distinct():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            values, rows = distinct_per_row(*word_hashes(*text_bytes(piece.column("__t")), ALNUM))
            return [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values.view(np.int64)))]

        return make

    held = with_columns(picked, "__t", distinct_field, prepare_distinct, ["__toxic"])
    counts = (
        held.select("__toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("__toxic").alias("bad"))
        .filter((F.col("bad") >= least) & (F.col("bad") >= F.col("n") * share))
    )
    chosen = counts.join(wide, "word").select("word").toArrow()
    vocabulary = np.sort(chosen.column(0).to_numpy().astype(np.int64).view(np.uint64))
    if not len(vocabulary):
        return Ordinal(vocabulary, np.zeros(0), np.zeros(0))
    sent = spark.sparkContext.broadcast(vocabulary)
    pair = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def prepare_counts():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            row, feature, count = feature_counts(piece.column("__t"), sent.value)
            offsets = np.searchsorted(row, np.arange(piece.num_rows + 1))
            listed = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), pa.array(count, pa.int32())], names=["feature", "n"])
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed)]

        return make

    counted = with_columns(picked, "__t", [T.StructField("counts", T.ArrayType(pair))], prepare_counts, ["__toxic"])
    data = counted.select("__toxic", "counts").toArrow().combine_chunks()  # at most `sample` rows
    sent.destroy()
    listed = data.column("counts").combine_chunks() if data.num_rows else pa.array([], pa.list_(pa.struct([])))
    bad = data.column("__toxic").to_numpy()
    rows = np.repeat(np.arange(len(bad)), listed.value_lengths().to_numpy(zero_copy_only=False))
    features, count = (listed.flatten().field(name).to_numpy().astype(kind) for name, kind in (("feature", np.int64), ("n", float)))
    hits = np.bincount(rows, count, minlength=len(bad))
    cuts = np.quantile(hits[bad == 1], [1 / 3, 2 / 3])
    grades = np.where(bad == 1, 1 + np.searchsorted(cuts, hits, "left"), 0)
    weights, thresholds = fitted_ordinal(rows, features, np.log1p(count), grades, len(vocabulary))
    return Ordinal(vocabulary, weights, thresholds)


def scored(docs: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `severity`, the expected grade of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        return lambda piece: [pa.array(sent.value.severity(piece.column(text)))]

    return with_columns(docs, text, [T.StructField("severity", T.DoubleType())], prepare, keep)
