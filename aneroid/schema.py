"""The one relation every operator works on: weather-station readings."""

from __future__ import annotations

from pyspark.sql import types as T

SENSOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("alt", T.DoubleType()),
        T.StructField("sats", T.IntegerType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("wind_direction", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("postal_code", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
    ]
)

TIME_COLUMNS = ("timestamp", "processed_at")

# Optional extra column: the calendar date of ``timestamp``, and the partition column of the
# stored layout (``write_readings``). Operators use it to skip files when it is there.
DAY = "reading_date"

# Fixed value: the postal code that stands for "unknown".
SENTINEL_POSTAL_CODE = "00000"

# The column lists of the answers.
PLACE_COLUMNS = ["lat", "lon", "temp", "humidity", "country", "state"]
LISTING_COLUMNS = [
    "device_id", "lat", "lon", "temp", "humidity", "pressure", "country", "state", "city", "postal_code",
]
PAGE_COLUMNS = [*LISTING_COLUMNS, "timestamp"]

# The location table. The key is also its clustering order, with timestamp descending.
LOCATION_COLUMNS = ["lat", "lon", "temp", "humidity", "country", "state", "postal_code", "timestamp", "id"]
LOCATION_KEY = ["lat", "lon", "country", "state", "postal_code", "timestamp", "id"]
