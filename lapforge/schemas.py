"""Schemas of the raw tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def schema(spec: str) -> T.StructType:
    """Build a StructType from `name:type` words; a `!` after the name marks a required column."""
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name.rstrip("!"), _TYPES[kind], not name.endswith("!")))
    return T.StructType(fields)


RACE_RESULTS = schema(
    "year!:int round!:int circuit_name!:string driver_code!:string driver_name:string team:string "
    "grid_position:int finish_position:int points:double status:string ingested_at:timestamp"
)
QUALIFYING_RESULTS = schema(
    "year!:int round!:int circuit_name!:string driver_code!:string driver_name:string team:string "
    "position:int q1_time:string q2_time:string q3_time:string ingested_at:timestamp"
)
LAP_TIMES = schema(
    "year!:int round!:int circuit_name!:string session_type!:string driver_code!:string "
    "lap_number!:int lap_time_seconds:double sector1_seconds:double sector2_seconds:double "
    "sector3_seconds:double compound:string tyre_life:int stint:int position:int "
    "is_personal_best:boolean ingested_at:timestamp"
)
WEATHER = schema(
    "year!:int round!:int circuit_name!:string session_type:string air_temp_avg:double "
    "track_temp_avg:double humidity_avg:double pressure_avg:double wind_speed_avg:double "
    "rainfall:boolean ingested_at:timestamp"
)
STANDINGS = schema(
    "season!:int round:int driver_code!:string driver_name:string team:string position:int "
    "points:double ingested_at:timestamp"
)
LIVE_LAPS = schema(
    "year!:int round!:int circuit_name:string driver_code!:string lap_number!:int "
    "lap_time_seconds:double sector1_seconds:double sector2_seconds:double sector3_seconds:double "
    "compound:string tyre_life:int position:int gap_to_leader:double published_at:timestamp "
    "ingested_at:timestamp"
)
QUERY_LOG = schema(
    "timestamp:timestamp question:string generated_sql:string response:string success:boolean "
    "error:string latency_ms:double model_used:string estimated_bytes:long"
)
SEASON_FILE = schema(
    "Track:string Position:string No:string Driver:string Team:string Points:double"
)

# Nested race documents: one row per race, drivers and sessions keyed by name.
RACE_DOCUMENT = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("circuit_name", T.StringType()),
        T.StructField("race_winner", T.StringType()),
        T.StructField(
            "drivers",
            T.MapType(
                T.StringType(),
                schema(
                    "name:string team:string race_position:int grid_position:int "
                    "qualifying_position:int race_points:double race_status:string"
                ),
            ),
        ),
        T.StructField(
            "sessions",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "raw_laps",
                            T.ArrayType(
                                schema(
                                    "session_type:string driver_code:string lap_number:int "
                                    "lap_time_seconds:double sector1_seconds:double "
                                    "sector2_seconds:double sector3_seconds:double "
                                    "compound:string tyre_life:int stint:int position:int "
                                    "is_personal_best:boolean"
                                )
                            ),
                        ),
                        T.StructField(
                            "raw_qualifying",
                            T.ArrayType(
                                schema(
                                    "driver_code:string driver_name:string team:string "
                                    "position:int q1_time:string q2_time:string q3_time:string"
                                )
                            ),
                        ),
                    ]
                ),
            ),
        ),
        T.StructField(
            "weather",
            schema(
                "available:boolean air_temp_avg:double track_temp_avg:double humidity_avg:double "
                "pressure_avg:double wind_speed_avg:double rainfall:boolean"
            ),
        ),
    ]
)

# Circuit dimension as stored in JSON: an object keyed by circuit.
CIRCUIT = T.StructType(
    [
        T.StructField("official_names", T.ArrayType(T.StringType())),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("circuit_type", T.StringType()),
        T.StructField("overtaking_difficulty", T.StringType()),
        T.StructField("qualifying_importance", T.DoubleType()),
        T.StructField("weather_sensitivity", T.DoubleType()),
        T.StructField("key_factors", T.ArrayType(T.StringType())),
        T.StructField(
            "location",
            T.StructType(
                [
                    T.StructField("city", T.StringType()),
                    T.StructField("country", T.StringType()),
                    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField(
            "typical_weather",
            T.StructType(
                [
                    T.StructField("temperature_range", T.ArrayType(T.DoubleType())),
                    T.StructField("rain_probability", T.DoubleType()),
                    T.StructField("heat_impact", T.StringType()),
                ]
            ),
        ),
    ]
)

# Parsed result files, one JSON object per file.
PARSED_FILE = T.StructType(
    [
        T.StructField("available", T.BooleanType()),
        T.StructField("session_available", T.BooleanType()),
        T.StructField("results", T.ArrayType(schema("position:int driver:string time:string"))),
        T.StructField("parsing_attempts", T.ArrayType(T.StringType())),
    ]
)
