"""Documents made ready for training, stage by stage.

Every stage takes the documents that the one before kept and returns documents, the last one
their token ids. Between stages the rows are written to the folder that all executors share,
so a lost executor costs one stage's task and never the whole chain.

Decisions are made for rows: a stage numbers the rows it reads, so rows that share a `doc_id`, or
have none, are each judged by their own text. Of a group of near copies the row of least `doc_id`
stays (null ids last, then any one row), whether the ids differ, repeat or are null. Null and empty
texts are kept as they are: they have no words, link with nothing, hold no benchmark passage and no
personal data, and encode to no tokens. Empty tables give empty tables. Columns beyond those of
`documents` are carried to the last stage, also ones named like a column that an operator adds.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import bpe_codec, decontam, jaccard_join, pii, toxicity
from lapforge.session import cut_lineage, shared_folder

SENT_ROWS = 500_000  # numbers of removed rows, eight bytes each, up to which they are sent to all tasks
ROW = "__pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number for each row. The rows come from written files, so it stays the same."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The numbered `docs` without the row numbers of `removed`, and without the numbers."""
    removed = cut_lineage(removed.select(ROW).distinct())
    if removed.count() <= SENT_ROWS:
        removed = F.broadcast(removed)
    return docs.join(removed, ROW, "left_anti").drop(ROW)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low expected severity; the labels' marks teach what is severe."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = toxicity.scored(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), model, names["text"])
    kept = scored.filter(F.col("severity") < toxicity.REJECT)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four fifths of 5-word shingles shared) the row of least id."""
    docs = numbered(docs)
    classes = jaccard_join.similarity_classes(docs.select(ROW, "text"), size=5, percent=80, id_=ROW)
    # Only classes of several rows have anything to remove; their rows alone are looked at.
    several = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    members = cut_lineage(classes.join(several, "component_id").join(docs.select(ROW, "doc_id"), ROW))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW))
    kept = members.groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return without(docs, members.join(kept, ROW, "left_anti"))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    docs = numbered(docs)
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[ROW])
    return without(docs, found.filter("n_hit > 0"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked, and `n_chars` counted anew where it was."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text, renamed = names["text"], docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    masked = pii.masked(pii.personal_spans(renamed, text), text)
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        kept = F.when(F.size("spans") > 0, length).otherwise(F.col(names["n_chars"]))
        masked = masked.withColumn(names["n_chars"], kept)
    return masked.select(*[F.col(n).alias(c) for c, n in names.items()])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and the text that the ids spell."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_codec.encode(docs, path, decoded="decoded", keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", harmless),
    ("ngram_jaccard_join", distinct),
    ("decontamination", unseen),
    ("personal_data", private),
    ("bpe", encoded),
]
# Severity, the learnt patterns and merges by rank are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's rows are written, then read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
