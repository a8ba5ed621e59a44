"""Sinks: overwrite, append, event reload, repartition, compaction, export, query log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.operators.cleaning import dedup_latest
from lapforge.operators.groups import group_quantiles, joined_on
from lapforge.sources.readers import read_table

EVENT_PARTITION = ["season_year", "round_number"]


def write_features(df: DataFrame, path: str) -> None:
    """Overwrite a feature table; as many files as tasks."""
    df.write.mode("overwrite").parquet(path)


def append_table(
    df: DataFrame, path: str, partition: Sequence[str] = ("season_year",), cluster: Sequence[str] = ("circuit_name",)
) -> None:
    """Append, partitioned on disk and clustered inside files for min/max skipping.

    Rows are rebalanced by partition and cluster columns: adaptive execution splits what
    is too large for one task and joins what is too small for a file.
    """
    keys = [*partition, *cluster]
    placed = df.hint("rebalance", *[F.col(c) for c in keys]).sortWithinPartitions(*keys)
    placed.write.mode("append").partitionBy(*partition).parquet(path)


def replace_events(df: DataFrame, path: str, keys: Sequence[str] = tuple(EVENT_PARTITION)) -> None:
    """Reload whole events: partitions present in `df` are replaced, all others kept."""
    (
        df.hint("rebalance", *[F.col(c) for c in keys])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def repartition_table(
    spark: SparkSession, src: str, dst: str, partition: Sequence[str], cluster: Sequence[str]
) -> tuple[int, int]:
    """Copy a table under another layout and return both row counts, which must agree."""
    source = read_table(spark, src)
    append_table(source, dst, partition, cluster)
    before, after = source.count(), read_table(spark, dst).count()
    if before != after:
        raise ValueError(f"{dst} has {after} rows, {src} has {before}")
    return before, after


def compact_dedup(spark: SparkSession, src: str, dst: str, keys: Sequence[str], order: Sequence[Column]) -> None:
    """Write a table without its older copies to a new path."""
    write_features(dedup_latest(spark.read.parquet(src), keys, order), dst)


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Export as `json` or `csv` (with header)."""
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def log_rows(df: DataFrame, response_chars: int | None = None) -> DataFrame:
    """Query-log rows with missing text empty; responses cut to `response_chars` where given."""
    response = F.coalesce("response", F.lit(""))
    return df.withColumns(
        {
            "response": response if response_chars is None else F.substring(response, 1, response_chars),
            "error": F.coalesce("error", F.lit("")),
        }
    )


def append_query_log(df: DataFrame, path: str, response_chars: int | None = None) -> None:
    log_rows(df, response_chars).write.mode("append").parquet(path)


def query_log_stats(log: DataFrame) -> DataFrame:
    """Success rate, latency percentiles and bytes per model and day; a model's day may hold any
    number of rows, and a missing model is one more."""
    keys = ["model_used", "day"]
    log = log.withColumn("day", F.to_date("timestamp"))
    totals = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.sum("estimated_bytes").alias("estimated_bytes"),
    )
    late = group_quantiles(log, keys, "latency_ms", {"latency_p50": "0.5", "latency_p95": "0.95"})
    return joined_on(totals, keys, late).select(
        *keys, "queries", "success_rate", "latency_p50", "latency_p95", "estimated_bytes"
    )
