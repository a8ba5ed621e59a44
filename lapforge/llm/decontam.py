"""Benchmark decontamination by winnowing.

Texts become word sequences. Each run of GRAM words has a hash; of every WINDOW consecutive
hashes the least (the last of equals) is a fingerprint. Two texts that share a span of
GRAM + WINDOW - 1 words share all its window minima, so they share a fingerprint in it:
nothing is missed. A shared fingerprint is extended: the spans of `size` words around it are
looked up among those of the benchmark, and the words of every span that is found are hit.
Benchmark items of fewer words are one span of their own length; lengths that occur are
winnowed with one-hash windows, so every position of a text is a candidate.

The benchmark's fingerprints go to all tasks as a bitmap of fixed size, whatever their number;
each task keeps the spans around fingerprints that may match, and Spark joins these with the
benchmark's spans. A full bitmap only means more spans to join.

Defined results: null or wordless texts have no words and no hits; repeated items each count;
repeated documents are each reported; an empty benchmark hits nothing; an empty table gives
an empty table; other columns play no part unless carried along with `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.llm.arrow import with_columns
from lapforge.llm.words import ALNUM, mix, text_bytes, word_hashes
from lapforge.session import cut_lineage

GRAM, WINDOW = 5, 6
FILTER_BITS = 25  # the bitmap of fingerprints has 2^25 bits, 4 MB
SENT_BYTES = 32 << 20  # bytes of benchmark spans, or of documents' hits, up to which they are sent to all tasks
_BASE = np.uint64(0xA24BAED4963EE407)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + len(out)]
    return mix(out + np.uint64(size))


def winnowed(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: minima of each `window` of consecutive hashes.

    `valid[i]` is false where the gram at i crosses the end of a text; windows with such a
    gram are left out. A text with fewer grams than the window has one window of them all,
    which the caller must see to.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    whole = valid[:n].copy()
    for k in range(1, window):
        later = grams[k : k + n]
        nearer = later <= least
        place[nearer] = k
        np.minimum(least, later, out=least)
        whole &= valid[k : k + n]
    picked = np.zeros(len(grams), bool)
    picked[(np.arange(n) + place)[whole]] = True
    return np.flatnonzero(picked)


def _inside(rows: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether the `size` words from each of `n` positions on lie in one row."""
    ends = np.repeat(rows[1:], np.diff(rows))[:n]
    return np.arange(n) + size <= ends


def benchmark_spans(benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Every span of each item: (item, n = its words, hash, prints = its fingerprints, item_words)."""
    fields = [
        T.StructField("item_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))])),
        ),
    ]

    def prepare():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            words, rows = word_hashes(*text_bytes(piece.column(text)), ALNUM)
            out = []
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                own, spans = words[a:b], []
                n = min(size, len(own))
                if n == size:
                    grams = gram_hashes(own, GRAM).view(np.int64)
                    for at, h in enumerate(gram_hashes(own, n).view(np.int64)):
                        near = grams[at : at + WINDOW].view(np.uint64)
                        least = len(near) - 1 - int(np.argmin(near[::-1]))
                        spans.append({"hash": int(h), "prints": [int(near.view(np.int64)[least])]})
                elif n:
                    h = int(gram_hashes(own, n).view(np.int64)[0])
                    spans.append({"hash": h, "prints": [h]})
                out.append(spans)
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("prints", pa.list_(pa.int64()))]))
            return [pa.array(np.diff(rows), pa.int64()), pa.array(out, kind)]

        return make

    rows = with_columns(benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")), "text", fields, prepare, keep=["item"])
    return rows.select(
        "item", "item_words", F.least("item_words", F.lit(size)).cast("int").alias("n"), F.inline("spans")
    )


def print_filter(spans: DataFrame) -> np.ndarray:
    """Bitmap of the fingerprints of `benchmark_spans`, as 64-bit words."""
    words = (
        spans.select(F.explode("prints").alias("print"))
        .select(F.shiftrightunsigned("print", 64 - FILTER_BITS).alias("cell"))
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(cell & 63 AS INT)))").alias("bits"))
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def _may_match(prints: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    cell = prints >> np.uint64(64 - FILTER_BITS)
    return (bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) != 0


def candidate_spans(
    docs: DataFrame,
    bitmap: np.ndarray,
    lengths: list[int],
    size: int = 10,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add `n_words` and `candidates`: the spans (start, n, hash) around each fingerprint that may
    match. `lengths` are the span lengths that occur in the benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("hash", T.LongType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("candidates", T.ArrayType(span))]

    def prepare():
        bits = sent.value

        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            words, rows = word_hashes(*text_bytes(piece.column(text)), ALNUM)
            found = []
            for n in lengths:
                grams = gram_hashes(words, n)
                whole = _inside(rows, n, len(grams))
                if n == size:
                    small = gram_hashes(words, GRAM)
                    at = winnowed(small, _inside(rows, GRAM, len(small)), WINDOW)
                    at = at[_may_match(small[at], bits)]
                    # The spans of `size` words that hold the gram.
                    at = np.unique((at[:, None] - np.arange(size - GRAM + 1)[None, :]).ravel())
                    at = at[(at >= 0) & (at < len(grams))]
                    at = at[whole[at]]
                else:
                    at = np.flatnonzero(whole)
                    at = at[_may_match(grams[at], bits)]
                found.append((at, np.full(len(at), n, np.int64), grams[at].view(np.int64)))
            start, n, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
            row = np.searchsorted(rows, start, "right") - 1
            order = np.argsort(row, kind="stable")
            offsets = np.searchsorted(row[order], np.arange(len(rows)))
            columns = [(start - rows[row], pa.int32()), (n, pa.int32()), (h, pa.int64())]
            spans = pa.StructArray.from_arrays([pa.array(c[order], k) for c, k in columns], names=["start", "n", "hash"])
            return [pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)]

        return make

    return with_columns(docs, text, fields, prepare, keep)


def covered(spans: Column) -> Column:
    """Number of places inside any of the spans (start, n), which are sorted."""
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, s: Column) -> Column:
        stop = s["start"] + s["n"]
        new = F.greatest(stop - F.greatest(state["upto"], s["start"]), F.lit(0))
        return F.struct(F.greatest(state["upto"], stop).alias("upto"), (state["n"] + new).alias("n"))

    return F.aggregate(spans, begin, step, lambda s: s["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text: str = "text",
    item: str = "item_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add to each document `n_words`, `hits` (the spans (start, n), in words, that occur in the
    benchmark), `n_hit` (words inside them) and `hit_items` (items with such a span, sorted as
    strings). `keep` names the other columns to carry along, by default all."""
    if size != GRAM + WINDOW - 1:
        raise ValueError(f"spans of {size} words need other grams than {GRAM} with windows of {WINDOW}")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "hit_items", "hits")]
    names = {c: f"__c{i}" for i, c in enumerate(kept)}
    whole = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("__t"))
    spans = cut_lineage(benchmark_spans(benchmark, size, text, item))
    lengths = [r["n"] for r in spans.select("n").distinct().collect()]  # at most `size` values
    items = spans.groupBy("n", "hash").agg(F.collect_set("item").alias("items"))
    if (spans.agg(F.sum(F.length(F.col("item").cast("string")) + 32)).first()[0] or 0) <= SENT_BYTES:
        items = F.broadcast(items)
    part = candidate_spans(whole, print_filter(spans), lengths, size, "__t", keep=list(names.values()))
    part = cut_lineage(part.withColumn("__row", F.monotonically_increasing_id()))
    hits = (
        part.select("__row", F.inline("candidates"))
        .join(items, ["n", "hash"])
        .groupBy("__row")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", "n"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"),
        )
    )
    hits = cut_lineage(hits)
    named = F.aggregate("__items", F.lit(0).cast("long"), lambda n, i: n + F.length(i.cast("string")) + 16)
    if (hits.agg(F.sum(named + F.size("hits") * 16 + 64)).first()[0] or 0) <= SENT_BYTES:
        hits = F.broadcast(hits)
    none = F.array().cast("array<struct<start:int,n:int>>")
    ordered = F.array_sort(F.transform("__items", lambda i: i.cast("string")))
    return part.join(hits, "__row", "left").select(
        *[F.col(n).alias(c) for c, n in names.items()],
        "n_words",
        F.coalesce(covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(ordered, F.array().cast("array<string>")).alias("hit_items"),
        F.coalesce("hits", none).alias("hits"),
    )
