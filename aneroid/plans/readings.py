"""The readings view over the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aneroid.sources.normalize import normalize
from aneroid.sources.readers import read_sensor


# The columns of the driver's table.
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# The readings expressed over those columns.
READING_EXPRESSIONS = [
    "event_id AS id",
    "concat('dev-', cast(user_id % 50 AS string)) AS device_id",
    "value AS temp",
    "cast(regexp_extract(props, '[0-9]+', 0) AS double) AS humidity",
    "1000 + cast(regexp_extract(props, '[0-9]+', 0) AS double) / 4 AS pressure",
    "cast((user_id % 30) * 4 - 58 AS double) AS lat",
    "cast((user_id % 25) * 14 - 170 AS double) AS lon",
    "cast(0 AS double) AS alt",
    "cast(user_id % 12 AS int) AS sats",
    "value / 8 AS wind_speed",
    "cast((user_id * 37) % 360 AS int) AS wind_direction",
    "CASE WHEN user_id % 3 = 0 THEN 'US' WHEN user_id % 3 = 1 THEN 'CA' ELSE 'IN' END AS country",
    "event_type AS state",
    "concat('city-', cast(user_id % 20 AS string)) AS city",
    "lpad(cast(user_id AS string), 5, '0') AS postal_code",
    "ts AS timestamp",
    "ts + INTERVAL '5' MINUTE AS processed_at",
]


# The same readings as a careless source delivers them: ids missing or repeated, times missing or cut to the
# minute (so that many agree), measurements and places missing, and the unknown place in other spellings.
HARD_VALUES = {
    "id": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN event_id - 1 ELSE event_id END",
    "temp": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END",
    "humidity": "CASE WHEN event_id % 19 = 0 THEN NULL "
                "ELSE cast(regexp_extract(props, '[0-9]+', 0) AS double) END",
    "postal_code": "CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '0' "
                   "WHEN event_id % 31 = 0 THEN '000000' ELSE lpad(cast(user_id AS {text}), 5, '0') END",
    "timestamp": "CASE WHEN event_id % 37 = 0 THEN NULL "
                 "WHEN event_id % 5 = 0 THEN cast(date_trunc('minute', ts) AS {time}) ELSE ts END",
}


def hard(expressions: list[str], text: str, time: str) -> list[str]:
    """The expressions with those of ``HARD_VALUES`` in place, in the names of either SQL dialect."""
    named = [(e.rsplit(" AS ", 1)[1], e) for e in expressions]
    return [f"{HARD_VALUES[n].format(text=text, time=time)} AS {n}" if n in HARD_VALUES else e for n, e in named]


def as_readings(events: DataFrame) -> DataFrame:
    """Events as station readings. Works on batch and streaming input."""
    return events.selectExpr(*READING_EXPRESSIONS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_sensor(spark, "parquet", f"{sf_dir}/events.parquet", schema=EVENTS_SCHEMA)
    return normalize(as_readings(events))


def hard_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_sensor(spark, "parquet", f"{sf_dir}/events.parquet", schema=EVENTS_SCHEMA)
    return normalize(events.selectExpr(*hard(READING_EXPRESSIONS, "string", "timestamp_ntz")))


def readings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as a stream of files."""
    return as_readings(spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet*"))
