"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from aneroid.plans.queries import BOX, DATE, FOLDED, INSTANTS, LABELLED, OVER_READINGS, POINT, RANGE, SUMMARIZED
from aneroid.plans.readings import READING_EXPRESSIONS, hard

READINGS = """
    SELECT event_id AS id,
           concat('dev-', cast(user_id % 50 AS varchar)) AS device_id,
           value AS temp,
           cast(regexp_extract(props, '[0-9]+', 0) AS double) AS humidity,
           1000 + cast(regexp_extract(props, '[0-9]+', 0) AS double) / 4 AS pressure,
           cast((user_id % 30) * 4 - 58 AS double) AS lat,
           cast((user_id % 25) * 14 - 170 AS double) AS lon,
           cast(0 AS double) AS alt,
           cast(user_id % 12 AS int) AS sats,
           value / 8 AS wind_speed,
           cast((user_id * 37) % 360 AS int) AS wind_direction,
           CASE WHEN user_id % 3 = 0 THEN 'US' WHEN user_id % 3 = 1 THEN 'CA' ELSE 'IN' END AS country,
           event_type AS state,
           concat('city-', cast(user_id % 20 AS varchar)) AS city,
           lpad(cast(user_id AS varchar), 5, '0') AS postal_code,
           ts AS timestamp,
           ts + INTERVAL '5' MINUTE AS processed_at
    FROM events
"""

KNOWN = "postal_code <> '00000'"
LATEST = "cast(timestamp AS date) = (SELECT max(cast(timestamp AS date)) FROM sensor_data)"
LATEST_KNOWN = f"cast(timestamp AS date) = (SELECT max(cast(timestamp AS date)) FROM sensor_data WHERE {KNOWN})"
ON_DATE = f"cast(timestamp AS date) = DATE '{DATE}'"
IN_RANGE = f"cast(timestamp AS date) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"
IN_INSTANTS = f"timestamp BETWEEN TIMESTAMP '{INSTANTS[0]}' AND TIMESTAMP '{INSTANTS[1]}'"
PLACE = "lat, lon, temp, humidity, country, state"
LISTING = "device_id, lat, lon, temp, humidity, pressure, country, state, city, postal_code"
NEWEST = "ORDER BY timestamp DESC NULLS LAST, id"
IN_BOX = f"lat BETWEEN {BOX[0]} AND {BOX[1]} AND lon BETWEEN {BOX[2]} AND {BOX[3]}"
AT_POINT = f"lat = {POINT[0]} AND lon = {POINT[1]}"


def _hourly_avg(where: str, avg: str = "avg({})") -> str:
    return f"""
        SELECT strftime(timestamp, '%H') AS hour,
               {avg.format('temp')} AS temperature, {avg.format('humidity')} AS humidity
        FROM sensor_data WHERE {KNOWN} AND {where} GROUP BY 1 ORDER BY 1
    """


ROUNDED = "floor(cast(sum(cast({0} AS decimal(18,6))) AS double) / count({0}) * 100 + 0.5) / 100"


def _first(
    grain: str, values: str, ts: str = "timestamp", order: str = "", extra: str = "", where: str = "true"
) -> str:
    """First reading per bucket; ``grain`` is an expression or a date_trunc unit."""
    unit = grain in ("hour", "day")
    bucket = f"date_trunc('{grain}', {ts})" if unit else grain
    return f"""
        SELECT {extra}{f'bucket AS {grain}' if unit else 'bucket AS hour'}, {values} FROM (
            SELECT *, {bucket} AS bucket,
                   row_number() OVER (PARTITION BY {bucket} ORDER BY {ts} NULLS LAST, id) AS rn
            FROM sensor_data WHERE {where}
        ) WHERE rn = 1 ORDER BY bucket {order}
    """


def _avg(bucket: str, where: str, metrics: tuple[str, ...] = ("temp",)) -> str:
    averages = ", ".join(f"avg({m}) AS avg_{m}" for m in metrics)
    return f"SELECT {bucket}, {averages} FROM sensor_data WHERE {where} GROUP BY 1 ORDER BY 1"


HOUR = "strftime(timestamp, '%H')"
DATE_LABEL = "strftime(timestamp, '%Y-%m-%d')"

LOCATION = """
    SELECT lat, lon, temp, humidity, country, state, postal_code, timestamp, id FROM (
        SELECT *, row_number() OVER (
            PARTITION BY lat, lon, country, state, postal_code, timestamp, id
            ORDER BY processed_at DESC NULLS LAST, temp DESC NULLS LAST, humidity DESC NULLS LAST) AS rn
        FROM sensor_data
        WHERE lat IS NOT NULL AND lon IS NOT NULL AND country IS NOT NULL AND state IS NOT NULL
          AND postal_code IS NOT NULL AND timestamp IS NOT NULL AND id IS NOT NULL
    ) WHERE rn = 1
"""

ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')"

PAGE_RECORD = (
    "{" + ", ".join(f"'{c}': {c}" for c in LISTING.split(", ")) + f", 'timestamp': {ISO}" + "}"
)

LATEST_LABEL = "SELECT max(strftime(timestamp, '%Y-%m-%d')) FROM sensor_data"
LATEST_KNOWN_LABEL = f"{LATEST_LABEL} WHERE {KNOWN}"


def _hour_envelope(name: str, where: str, date: str, label: bool = False, day: bool = False) -> str:
    """The first reading of each hour as one JSON array, beside a date."""
    shown = "'date': strftime(timestamp, '%Y-%m-%d'), " if label or day else ""
    return f"""
        SELECT ({date}) AS date,
               cast(to_json(list({{{shown}'hour': strftime(timestamp, '%H'), 'temp': temp}}
                                 ORDER BY hour(timestamp))) AS varchar) AS {name}
        FROM (SELECT *, row_number() OVER (PARTITION BY hour(timestamp) ORDER BY timestamp, id) AS rn
              FROM sensor_data WHERE {where}) WHERE rn = 1"""


SQL: dict[str, str] = {
    "hourly_avg_latest": _hourly_avg(LATEST_KNOWN),
    "hourly_avg_on_date": _hourly_avg(ON_DATE),
    "hourly_avg_latest_rounded": _hourly_avg(LATEST_KNOWN, ROUNDED),
    "first_temp_per_hour_top50": _first("hour", "temp", order="DESC NULLS LAST LIMIT 50"),
    "first_temp_per_hour_top100": _first("hour", "temp", order="DESC NULLS LAST LIMIT 100"),
    "first_temp_humidity_per_day": _first("day", "temp, humidity", order="NULLS LAST LIMIT 50"),
    "first_temp_pressure_per_day": _first("day", "temp, pressure", order="NULLS LAST LIMIT 50"),
    "first_temp_per_day_processed_at": _first("day", "temp", ts="processed_at", order="NULLS LAST LIMIT 50"),
    "first_per_hour_latest": _first(HOUR, "temp", extra=f"{DATE_LABEL} AS date, ", where=LATEST),
    "first_per_hour_on_date": _first(HOUR, "temp", where=ON_DATE),
    "first_per_hour_latest_filtered": _first(
        HOUR, "temp", extra="cast(timestamp AS date) AS date, ", where=f"{KNOWN} AND {LATEST_KNOWN}"
    ),
    "first_per_hour_all": _first("hour", "temp, humidity, pressure"),
    "latest_day_rows": f"SELECT {DATE_LABEL} AS date, {HOUR} AS hour, temp FROM sensor_data WHERE {LATEST}",
    "hour_rows_on_date": f"""
        SELECT hour(timestamp) AS hour_start, temp FROM sensor_data WHERE {KNOWN} AND {ON_DATE}
        ORDER BY hour(timestamp), timestamp, id LIMIT 50""",
    "dated_rows_on_date": f"""
        SELECT temp, timestamp, cast(timestamp AS date) AS formatted_timestamp FROM sensor_data
        WHERE {ON_DATE} ORDER BY timestamp, id LIMIT 10""",
    "avg_all": "SELECT avg(temp) AS avg_temp FROM sensor_data",
    "avg_on_date": f"SELECT avg(temp) AS avg_temp FROM sensor_data WHERE {ON_DATE}",
    "min_on_date": f"SELECT min(temp) AS min_temp FROM sensor_data WHERE {ON_DATE}",
    "max_on_date": f"SELECT max(temp) AS max_temp FROM sensor_data WHERE {ON_DATE}",
    "avg_by_date_on_date": _avg("cast(timestamp AS date) AS date", f"{KNOWN} AND {ON_DATE}"),
    "avg_by_date_range": _avg("cast(timestamp AS date) AS date", f"{KNOWN} AND {IN_RANGE}"),
    "avg_by_instant_range": _avg("cast(timestamp AS date) AS date", IN_INSTANTS),
    "avg_by_hour_of_day": _avg("hour(timestamp) AS hour_start", ON_DATE),
    "avg_by_hour_range": _avg("date_trunc('hour', timestamp) AS hour_start", f"{KNOWN} AND {IN_RANGE}"),
    "avg_by_day": _avg("date_trunc('day', timestamp) AS day", KNOWN, ("temp", "humidity")),
    "avg_by_week": _avg("date_trunc('week', timestamp) AS week_start", KNOWN),
    "avg_by_month": _avg("date_trunc('month', timestamp) AS month_start", KNOWN),
    "avg_by_year": _avg("date_trunc('year', timestamp) AS year_start", KNOWN),
    "distinct_dates_top50": f"SELECT DISTINCT {DATE_LABEL} AS date FROM sensor_data ORDER BY date DESC LIMIT 50",
    "distinct_dates_known_places": f"SELECT DISTINCT {DATE_LABEL} AS date FROM sensor_data WHERE {KNOWN}",
    "row_count": "SELECT count(*) AS total FROM sensor_data",
    "known_places": f"SELECT * FROM sensor_data WHERE {KNOWN}",
    "sample_recent": f"SELECT {LISTING} FROM sensor_data {NEWEST} LIMIT 50",
    "sample_drawn": f"""
        SELECT {LISTING} FROM sensor_data
        ORDER BY md5(concat_ws('|', '7', city, country, device_id, id, postal_code, processed_at, sats, state,
                               timestamp, wind_direction)) LIMIT 500""",
    "page": f"SELECT {LISTING}, timestamp FROM sensor_data {NEWEST} LIMIT 50 OFFSET 0",
    "page_offset": f"SELECT {LISTING}, timestamp FROM sensor_data {NEWEST} LIMIT 40 OFFSET 120",
    "page_deep": f"SELECT {LISTING}, timestamp FROM sensor_data {NEWEST} LIMIT 200 OFFSET 700",
    "page_after": f"""
        SELECT {LISTING}, timestamp FROM sensor_data
        WHERE timestamp < TIMESTAMP '2024-01-20 12:00:00'
           OR (timestamp = TIMESTAMP '2024-01-20 12:00:00' AND id > 0) OR timestamp IS NULL
        {NEWEST} LIMIT 100""",
    "page_envelope": f"""
        SELECT cast(to_json(list({PAGE_RECORD} {NEWEST})) AS varchar) AS sensor_data,
               (SELECT count(*) FROM sensor_data) AS total,
               cast(10 AS int) AS "offset", cast(25 AS int) AS "limit", 'success' AS status
        FROM (SELECT * FROM sensor_data {NEWEST} LIMIT 25 OFFSET 10)""",
    "point_lookup": f"SELECT {PLACE} FROM sensor_data WHERE {AT_POINT}",
    "bounding_box": f"SELECT {PLACE} FROM sensor_data WHERE {IN_BOX}",
    "bounding_box_top10": f"SELECT {PLACE} FROM sensor_data WHERE {IN_BOX} {NEWEST} LIMIT 10",
    "by_country": f"SELECT {PLACE} FROM sensor_data WHERE country = 'US'",
    "by_country_state": f"SELECT {PLACE} FROM sensor_data WHERE country = 'US' AND state = 'error'",
    "strict_timestamps": "SELECT id, timestamp, processed_at FROM sensor_data",
    "adhoc_sql": """
        SELECT state, avg(temp) AS avg_temp, count(*) AS n FROM sensor_data
        WHERE country = 'CA' AND cast(timestamp AS date) =
              (SELECT max(cast(timestamp AS date)) FROM sensor_data WHERE country = 'CA')
        GROUP BY state ORDER BY state""",
    "adhoc_sql_labels": f"SELECT * FROM ({LABELLED.strip(chr(10) + '; ')})",
    "json_records": f"""
        SELECT cast(to_json({{'id': id, 'device_id': device_id, 'temp': temp, 'humidity': humidity,
                              'timestamp': {ISO}}}) AS varchar) AS record
        FROM sensor_data""",
    "hourly_avg_envelope": f"""
        SELECT (SELECT max({DATE_LABEL}) FROM sensor_data WHERE {KNOWN}) AS date,
               cast(to_json(list({{'hour': hour, 'temperature': temperature, 'humidity': humidity}}
                                 ORDER BY hour)) AS varchar) AS records
        FROM ({_hourly_avg(LATEST_KNOWN, ROUNDED)})""",
    "first_per_hour_envelope": _hour_envelope("temp_hourly", LATEST, LATEST_LABEL),
    "first_per_hour_debug_envelope": _hour_envelope("temp_hourly", LATEST, LATEST_KNOWN_LABEL, label=True),
    "single_date_envelope": _hour_envelope("records", f"{KNOWN} AND {LATEST_KNOWN}", LATEST_KNOWN_LABEL, day=True),
    "location_index": LOCATION,
    "location_index_streamed": LOCATION,
    "location_index_compacted": LOCATION,
    "point_lookup_compacted": f"SELECT * FROM ({LOCATION}) WHERE {AT_POINT}",
    "point_lookup_indexed": f"SELECT * FROM ({LOCATION}) WHERE {AT_POINT}",
    "bounding_box_indexed": f"SELECT {PLACE} FROM sensor_data WHERE {IN_BOX}",
    "bounding_box_indexed_top10": f"SELECT {PLACE} FROM sensor_data WHERE {IN_BOX} {NEWEST} LIMIT 10",
    "stored_hourly_avg_latest": _hourly_avg(LATEST_KNOWN),
    "stored_first_temp_per_hour_top50": _first("hour", "temp", order="DESC NULLS LAST LIMIT 50"),
    "stored_page": f"SELECT {LISTING}, timestamp FROM sensor_data {NEWEST} LIMIT 50",
}


def _over(view: str, sql: str) -> str:
    return f"WITH sensor_data AS ({view})\n{sql}"


HARD_READINGS = f"SELECT {', '.join(hard(READING_EXPRESSIONS, 'varchar', 'timestamp'))} FROM events".replace(
    " AS string)", " AS varchar)"
)

ORACLES: dict[str, str] = {
    **{name: _over(READINGS, sql) for name, sql in SQL.items()},
    **{f"hard_{name}": _over(HARD_READINGS, SQL[name]) for name in OVER_READINGS},
    **{f"summary_{name}": _over(READINGS, SQL[name]) for name in SUMMARIZED},
    **{f"hard_summary_{name}": _over(HARD_READINGS, SQL[name]) for name in SUMMARIZED},
    **{f"partials_{name}": _over(READINGS, SQL[name]) for name in FOLDED},
    **{f"hard_partials_{name}": _over(HARD_READINGS, SQL[name]) for name in FOLDED},
}
