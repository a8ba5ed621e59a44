"""Session settings and the shared folder for cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for. Shuffle partitions are left to
# AQE: it coalesces small ones and splits skewed ones from a generous start.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "lapforge", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the settings above; `conf` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Only a local session without one gets a temporary folder of its own; on a cluster a
    machine-local folder would not survive the loss of its machine, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="lapforge-")
    return _local_folders[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize `df` in the shared folder so lost executors do not recompute its past."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside it, the folders of a table are listed by two tasks per core; by default Spark starts a task
    for each of up to 10,000 folders, which takes longer than to list one."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


SHUFFLE = "spark.sql.shuffle.partitions"


@contextmanager
def few_state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside it keep their state in one partition a core at most. Each partition is a task and
    files in every trigger, however little comes in, and a stream cannot change their number later."""
    before = spark.conf.get(SHUFFLE)
    spark.conf.set(SHUFFLE, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE, before)


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def joins_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Inside it, sides that are dealt alike by some of the keys of a join are joined where they are; by
    default Spark deals them again by all keys. For what runs inside, such as the writing of a staged
    table, and where the rows that share the fewer keys are known to be few."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


_staged: dict[tuple[str, str], str] = {}


def staged(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application to the shared folder and read from there.

    For tables that several stages or queries build on: it is computed once, keeps
    pushdown and column pruning, and survives lost executors. Its files are packed, so their
    size says little about the rows: joins of it are merged unless a smaller side is marked to
    be sent, and the table itself never goes through the driver.
    """
    app = spark.sparkContext.applicationId
    if (app, name) not in _staged:
        path = f"{shared_folder(spark)}/lapforge/{app}/{name}"
        build().write.mode("overwrite").parquet(path)
        _staged[app, name] = path
    return spark.read.parquet(_staged[app, name]).hint("merge")


def forget_staged() -> None:
    """Make the next use of every staged table write it anew."""
    _staged.clear()
