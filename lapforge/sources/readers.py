"""Scans: laps, warehouse tables, season files, dimensions, nested race documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge import schemas
from lapforge.functions.scalar import duration_seconds
from lapforge.session import few_listing_tasks

# Raw timing columns, in the order of the lap table.
RAW_LAP = {
    "driver_code": "Driver",
    "lap_number": "LapNumber",
    "lap_time_seconds": "LapTime",
    "sector1_seconds": "Sector1Time",
    "sector2_seconds": "Sector2Time",
    "sector3_seconds": "Sector3Time",
    "compound": "Compound",
    "tyre_life": "TyreLife",
    "stint": "Stint",
    "position": "Position",
}


def read_laps(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet laps; with a schema no file is opened to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with any number of partition folders."""
    with few_listing_tasks(spark):
        return spark.read.parquet(path)


def read_warehouse(spark: SparkSession, table: str, fmt: str, **options: str) -> DataFrame:
    """A table through a connector, views allowed.

    Connectors take the table as an option; for file formats it is the path.
    """
    reader = spark.read.format(fmt).options(viewsEnabled="true", **options)
    if fmt in ("parquet", "orc", "json", "csv"):
        return reader.load(table)
    return reader.option("table", table).load()


def ingest_laps(raw: DataFrame) -> DataFrame:
    """Raw timing records to the 14-column lap schema; durations become seconds.

    `raw` has `year`, `round`, `circuit_name`, `session_type` and the timing columns.
    Rows without a driver, lap number or positive lap time are left out.
    """

    def whole(col: str) -> Column:
        value = F.col(col).cast("double")
        return F.when(~F.isnan(value), F.floor(value)).cast("int")

    def seconds(col: str) -> Column:
        kind = raw.schema[col].dataType
        return duration_seconds(F.col(col)) if isinstance(kind, T.DayTimeIntervalType) else F.round(F.col(col).cast("double"), 3)

    columns = [F.col("year").cast("int"), F.col("round").cast("int"), "circuit_name", F.upper("session_type").alias("session_type")]
    for name, source in RAW_LAP.items():
        if name.endswith("_seconds"):
            columns.append(seconds(source).alias(name))
        elif name in ("lap_number", "tyre_life", "stint", "position"):
            columns.append(whole(source).alias(name))
        else:
            columns.append(F.col(source).cast("string").alias(name))
    laps = raw.select(*columns)
    present = (F.coalesce("driver_code", F.lit("")) != "") & F.col("lap_number").isNotNull()
    return laps.filter(present & (F.col("lap_time_seconds") > 0))


def read_season_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = schemas.SEASON_FILE) -> DataFrame:
    """Season files with a header; values that do not fit the schema become NULL."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("header", True).schema(schema).csv(paths)


def read_dimension_json(spark: SparkSession, path: str, key: str, schema: T.StructType = schemas.CIRCUIT) -> DataFrame:
    """A JSON object keyed by id, as one row per id."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), schema))
    return whole.select(F.explode(parsed).alias(key, "__row")).select(key, "__row.*")


def read_seed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A seed file with typed columns."""
    return spark.read.option("header", True).schema(schema).csv(path)


def summarize_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per parsed result file: availability, result count, first three, attempts."""
    files = spark.read.option("wholetext", True).text(path).withColumn("__d", F.from_json("value", schemas.PARSED_FILE))
    results = F.col("__d.results")
    top = F.transform(
        F.slice(results, 1, 3),
        lambda r: F.concat_ws(" - ", F.coalesce(r["driver"], F.lit("Unknown")), F.coalesce(r["time"], F.lit("No time"))),
    )
    partitions = [c for c in files.columns if c not in ("value", "__d")]
    return files.select(
        *partitions,
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.coalesce("__d.available", "__d.session_available").alias("available"),
        F.coalesce(F.size(results), F.lit(0)).alias("results_count"),
        F.coalesce(top, F.array().cast("array<string>")).alias("top_3"),
        F.coalesce(F.size("__d.parsing_attempts"), F.lit(0)).alias("attempts"),
    )


def flatten_races(docs: DataFrame) -> dict[str, DataFrame]:
    """Nested race documents to the four fact tables.

    The grid is the real one where known, else the qualifying position. Qualifying rows
    need a driver code, weather rows available weather; the weather is the race's.
    """
    event = ["year", "round", "circuit_name"]
    driver = F.col("d")
    results = docs.select(*event, F.explode("drivers").alias("driver_code", "d")).select(
        *event,
        "driver_code",
        F.coalesce(driver["name"], F.lit("")).alias("driver_name"),
        F.coalesce(driver["team"], F.lit("")).alias("team"),
        F.coalesce(driver["grid_position"], driver["qualifying_position"]).alias("grid_position"),
        driver["race_position"].alias("finish_position"),
        F.coalesce(driver["race_points"], F.lit(0.0)).alias("points"),
        F.coalesce(driver["race_status"], F.lit("Unknown")).alias("status"),
    )
    sessions = docs.select(*event, F.explode("sessions").alias("session_name", "s"))
    quali = (
        sessions.filter(F.col("session_name") == "Qualifying")
        .select(*event, F.explode("s.raw_qualifying").alias("q"))
        .select(*event, "q.*")
        .filter(F.coalesce("driver_code", F.lit("")) != "")
    )
    laps = sessions.select(*event, "session_name", F.explode("s.raw_laps").alias("l")).select(*event, "session_name", "l.*")
    laps = laps.withColumn("session_type", F.coalesce("session_type", F.upper("session_name"))).drop("session_name")
    weather = docs.filter(F.col("weather.available")).select(
        *event, F.lit("RACE").alias("session_type"), "weather.*"
    ).drop("available").withColumn("rainfall", F.coalesce("rainfall", F.lit(False)))
    return {"race_results": results, "qualifying_results": quali, "lap_times": laps, "weather": weather}
