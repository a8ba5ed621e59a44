"""Streaming ingest of laps: decode, deduplicate, append in micro-batches, drain, reconcile."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lapforge import schemas
from lapforge.operators.marts import load_check
from lapforge.session import few_listing_tasks


def read_lap_stream(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """A stream with a string `value`: `text` files, or `kafka` with its payload."""
    stream = spark.readStream.format(fmt).options(**options).load()
    return stream.select(F.col("value").cast("string").alias("value"), *[c for c in stream.columns if c != "value"])


def decode(stream: DataFrame, schema: T.StructType = schemas.LIVE_LAPS, col: str = "value") -> DataFrame:
    """JSON messages to rows; a message that is not JSON gives NULL columns, which are dropped."""
    rows = stream.select(F.from_json(col, schema).alias("__m")).select("__m.*")
    required = [f.name for f in schema.fields if not f.nullable]
    return rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in required)) if required else rows


def stamp_published(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Add `published_at`, by default the time of the micro-batch."""
    return df.withColumn("published_at", F.current_timestamp() if at is None else at)


TRIGGERS = 32  # triggers that a replay of more slices has at least


def replay(
    df: DataFrame, path: str, rows_per_slice: int, order: Sequence[str] = ("lap_number", "driver_code")
) -> DataFrame:
    """Publish history slice by slice and return a stream that reads whole slices in their order.

    Slices are ranges of `order` of about `rows_per_slice` rows, each one sorted file. One job
    writes them all next to `path`, whatever their number. File streams go by modification time, so
    the files get times in the order of their names before the folder is published by renaming it;
    the file system must keep the times it is told to set. The pace is the reader's trigger interval.
    A trigger takes one slice while there are less than twice `TRIGGERS`, and then so many that there are
    `TRIGGERS` to twice as many triggers: a trigger has its fixed time, and a slice alone works one core.
    """
    spark = df.sparkSession
    slices = max(1, -(-df.count() // rows_per_slice))
    ordered = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    cut = f"{path}-slices"
    # A slice is one file: no task may start another one.
    ordered.write.option("maxRecordsPerFile", 0).parquet(cut)
    _publish(spark, cut, path)
    at_once = max(1, slices // TRIGGERS)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def _publish(spark: SparkSession, cut: str, path: str) -> None:
    """Give the files of `cut` modification times a second apart, by name, and rename it to `path`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(cut), hadoop.Path(path)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in files.listStatus(source)), key=lambda p: p.getName())
    parts = [p for p in parts if p.getName().startswith("part-")]
    first = int(time.time() * 1000) - 1000 * len(parts)
    for i, part in enumerate(parts):
        files.setTimes(part, first + 1000 * i, -1)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{cut} could not be renamed to {path}")


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Drop redelivered rows seen within `delay`; state is bounded by the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def append_live(batch: DataFrame, path: str, batch_id: int, run: str) -> None:
    """Append one micro-batch of a run; a repeated batch overwrites its own folder instead of doubling."""
    batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


FEW_EVENTS = 64  # events up to which a batch gets a folder for each
MANY = "many"
RANGED = (T.IntegralType, T.StringType, T.DateType)  # types of keys that are looked for between two ends
LAYOUT = [T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("scope", T.StringType())]


def append_once(
    batch: DataFrame, path: str, batch_id: int, run: str, keys: Sequence[str], event: Sequence[str]
) -> None:
    """Append the rows of a micro-batch that the sink does not hold yet, however long ago it got them.

    A batch of few events, as live ones are, has a folder for each; one of more events has one
    folder, so files go with batches and not with batches times events. Only the folders of the
    batch's own events and those of many events are read, and of these only the keys that lie between
    the least and the greatest of the batch: files and stretches of files beyond them are passed over.
    No state is kept between batches. Rows of equal `keys` inside the batch count once; a repeated
    batch does not see its own earlier attempt.
    """
    spark, event, keys = batch.sparkSession, list(event), list(keys)
    name = F.hex(F.xxhash64(*event))
    fresh = batch.dropDuplicates(keys).persist()
    try:
        ranged = [c for c in keys if isinstance(batch.schema[c].dataType, RANGED)]
        ends = [end(c).alias(f"__{end.__name__}_{c}") for c in ranged for end in (F.min, F.max)]
        found = fresh.agg(F.collect_set(name).alias("__scopes"), *ends).first()
        scopes = found["__scopes"]
        fresh_rows = fresh
        with few_listing_tasks(spark):
            sink = _sink(spark, path, T.StructType([*batch.schema.fields, *LAYOUT]))
        if scopes and sink is not None:
            own = (F.col("run") == run) & (F.col("batch_id") == batch_id)
            held = sink.filter(F.col("scope").isin([*scopes, MANY]) & ~own)
            for c in ranged:
                # A null key equals none: without other keys in the batch, nothing of the sink does.
                held = held.filter(F.col(c).between(F.lit(found[f"__min_{c}"]), F.lit(found[f"__max_{c}"])))
            same = [fresh[c] == held[c] for c in keys] + [fresh[c].eqNullSafe(held[c]) for c in event if c not in keys]
            fresh_rows = fresh.join(held, reduce(and_, same), "left_anti")
        folder = f"{path}/run={run}/batch_id={batch_id}"
        placed = fresh_rows.select(*batch.columns, (name if len(scopes) <= FEW_EVENTS else F.lit(MANY)).alias("scope"))
        placed.write.mode("overwrite").partitionBy("scope").parquet(folder)
    finally:
        fresh.unpersist()


def _sink(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame | None:
    """A sink that was written to before."""
    try:
        return spark.read.schema(layout).parquet(path)
    except AnalysisException:
        return None


def microbatch(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    seconds: float | None = 2.0,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    once: Sequence[str] = (),
    event: Sequence[str] = (),
    mode: str = "append",
) -> StreamingQuery:
    """Flush the stream into `path` every `seconds`, or everything there is and stop for None.

    The number of rows per flush is limited at the source (`maxFilesPerTrigger`,
    `maxOffsetsPerTrigger`). Batches go into a folder of their checkpoint's query id: a stream
    that goes on appends to it, one with a new checkpoint never replaces what others wrote.
    With `once`, the key of a row, rows that the sink holds already are dropped (`append_once`).
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = transform(batch) if transform else batch
        if once:
            append_once(rows, path, batch_id, run, once, event)
        else:
            append_live(rows, path, batch_id, run)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(flush)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def drain(query: StreamingQuery, timeout: float | None = 300.0) -> bool:
    """Wait until an available-now query has finished; stop it if it takes too long (None: never)."""
    if timeout is None:
        query.awaitTermination()
        return True
    done = query.awaitTermination(timeout)
    if not done:
        query.stop()
    return bool(done)


def reconcile(spark: SparkSession, path: str, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Persisted against expected row counts per event."""
    return load_check(spark.read.parquet(path), expected, keys)


def content_digest(df: DataFrame, event: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per event the row count and two digests of its rows as a multiset.

    Sums and xors of row hashes merge in any order, so they are made before the shuffle and an
    event of any size costs one row per task. A lost row and a doubled one, which leave the count
    as it was, change both.
    """
    row = [F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]) for seed in (1, 2)]
    return df.groupBy(*event).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(row[0].cast("decimal(20,0)")).alias("digest_sum"),
        F.bit_xor(row[1]).alias("digest_xor"),
    )


def reconcile_content(
    actual: DataFrame, expected: DataFrame, event: Sequence[str], keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per event: expected and loaded rows, and how many rows are lost, doubled, or changed.

    Digests of all events are compared first; only the events whose digests differ are looked at
    row by row. `keys` name a row inside its event, `columns` are compared. A key that is there
    less often than expected counts as lost, more often as doubled (or foreign, where none was
    expected); one that is there as often but not with the same content counts as changed.
    """
    event, keys, columns = list(event), list(keys), list(columns)
    zero = F.lit(0).cast("long")
    sides = [
        content_digest(df, event, [*keys, *columns]).select(
            *event, F.struct("n", "digest_sum", "digest_xor").alias(name)
        )
        for df, name in ((expected, "wanted"), (actual, "found"))
    ]
    both = sides[0].join(sides[1], event, "full")
    same = F.col("wanted").eqNullSafe(F.col("found"))
    differing = both.filter(~same).select(*event)

    def rows(df: DataFrame, name: str) -> DataFrame:
        """Count and content digest per key of the differing events."""
        return (
            df.join(differing, event, "left_semi")
            .groupBy(*event, *keys)
            .agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias(f"{name}_c"))
        )

    pairs = rows(expected, "wanted").join(rows(actual, "found"), [*event, *keys], "full")
    wanted, found = F.coalesce("wanted_n", zero), F.coalesce("found_n", zero)
    faults = pairs.groupBy(*event).agg(
        F.sum(F.greatest(wanted - found, zero)).alias("lost_rows"),
        F.sum(F.greatest(found - wanted, zero)).alias("doubled_rows"),
        F.count_if((wanted == found) & (F.col("wanted_c") != F.col("found_c"))).alias("changed_rows"),
    )
    counts = ("lost_rows", "doubled_rows", "changed_rows")
    return both.join(faults, event, "left").select(
        *event,
        F.coalesce("wanted.n", zero).alias("expected_rows"),
        F.coalesce("found.n", zero).alias("loaded_rows"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
        same.alias("same"),
    )
