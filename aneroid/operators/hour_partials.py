"""Mergeable aggregates per hour beside the stored readings, from which every coarser answer is folded.

One row per file, day, hour and whether the place is known: per metric the count, the sum, the exact decimal sum,
least and largest value, and the hour's first reading by time and id. Sums, counts, extremes and first readings of
parts give those of the whole, so averages, extremes and series at every grain come from rows whose number
goes with files and hours, and the readings are not opened. Like the day summary it is kept per file (see
``file_summary``): an append adds the partials of its files, and partials of other files are refused.

Only a range between two instants inside an hour needs readings: those of its first and last hour.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aneroid.functions.times import GRAINS, bucket_value, check_grain, date_label, hour_label, parse_date
from aneroid.operators import file_summary
from aneroid.operators.filters import between_instants, day_of
from aneroid.schema import SENTINEL_POSTAL_CODE

METRICS = ["temp", "humidity", "pressure"]
HOUR = dt.timedelta(hours=1)
MICROSECOND = dt.timedelta(microseconds=1)


def _metric(name: str) -> Column:
    value = F.col(name)
    exact = value.try_cast("decimal(28,6)")
    return F.struct(
        F.count(value).alias("n"), F.sum(value).alias("total"),
        F.count(exact).alias("exact_n"), F.sum(exact).alias("exact"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).alias(name)


def _partials(readings: DataFrame, file: list[Column] = ()) -> DataFrame:
    ts, known = F.col("timestamp"), F.col("postal_code") != SENTINEL_POSTAL_CODE
    # a struct compares field by field, so the least one is the earliest reading; no id comes after every id
    first = F.struct(ts.alias("at"), F.col("id").isNull().alias("no_id"), "id", *METRICS)
    keys = [day_of(readings).alias("day"), F.hour(ts).alias("hour"), F.coalesce(known, F.lit(False)).alias("known")]
    return readings.groupBy(*file, *keys).agg(
        F.count("*").alias("rows"), *map(_metric, METRICS), F.min(first).alias("first")
    )


def write_hour_partials(spark: SparkSession, readings: str, path: str) -> None:
    """Write the partials of the readings that ``write_readings`` stored at ``readings`` to a new ``path``."""
    file_summary.write(spark, readings, path, _partials)


def extend_hour_partials(spark: SparkSession, readings: str, path: str) -> None:
    """Add the partials of the files that were written since, reading those alone."""
    file_summary.extend(spark, readings, path, _partials)


def read_hour_partials(spark: SparkSession, readings: str, path: str) -> DataFrame:
    """The partials; evaluating them fails when they are not of the files in ``readings``."""
    return file_summary.read(spark, readings, path, "table of hour partials").drop(*file_summary.FILE)


def _average(metric: str, digits: int | None) -> Column:
    """Of partials as ``avg`` and ``rounded_avg`` of the readings: exact sums only where every value has one."""
    n = F.sum(f"{metric}.n")
    mean = F.sum(f"{metric}.total") / F.nullif(n, F.lit(0))
    if digits is None:
        return mean
    scale = float(10**digits)
    exact = F.sum(f"{metric}.exact").cast("double") / F.nullif(n, F.lit(0))
    mean = F.when(F.sum(f"{metric}.exact_n") == n, exact).otherwise(mean)
    return F.when(F.abs(mean * scale) < 1e15, F.floor(mean * scale + 0.5) / scale).otherwise(mean)


def _keys(grain: str) -> list[Column]:
    check_grain(grain)
    day, hour = F.col("day"), F.col("hour")
    if grain == "hour":
        return [day, hour]
    if grain == "hour_of_day":
        return [hour]
    return [day if grain in ("date", "day") else F.trunc(day, grain)]


def _known(parts: DataFrame, only: bool) -> DataFrame:
    return parts.where("known") if only else parts


def _between(
    parts: DataFrame, start: dt.date | dt.datetime | str, end: dt.date | dt.datetime | str, readings: DataFrame | None
) -> DataFrame:
    if not (isinstance(start, dt.datetime) or isinstance(end, dt.datetime)):
        return parts.where(F.col("day").between(F.lit(parse_date(start)), F.lit(parse_date(end))))
    if readings is None:
        raise ValueError("a range of instants needs the readings of its first and last hour")
    start, end = (x if isinstance(x, dt.datetime) else dt.datetime.combine(parse_date(x), dt.time()) for x in (start, end))
    first, last = (x.replace(minute=0, second=0, microsecond=0) for x in (start, end))
    begins = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    within = F.col("day").between(F.lit(first.date()), F.lit(last.date()))
    whole = parts.where(within & (begins > F.lit(first).cast("timestamp_ntz")) & (begins < F.lit(last).cast("timestamp_ntz")))
    for a, b in {(start, min(end, first + HOUR - MICROSECOND)), (max(start, last), end)}:
        whole = whole.unionByName(_partials(between_instants(readings, a, b)))
    return whole


def average_by(
    parts: DataFrame,
    grain: str,
    metrics: list[str],
    start: dt.date | dt.datetime | str | None = None,
    end: dt.date | dt.datetime | str | None = None,
    drop_sentinel: bool = True,
    digits: int | None = None,
    readings: DataFrame | None = None,
) -> DataFrame:
    """As ``aggregates.average_by``. For a range of instants, give the ``readings``: two hours of them are read."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    rows = parts if start is None else _between(parts, start, end, readings)
    rows = _known(rows, drop_sentinel)
    averages = [_average(m, digits).alias(f"avg_{m}") for m in metrics]
    if grain == "all":
        return rows.agg(*averages)
    names = [f"key{i}" for i in range(len(_keys(grain)))]
    grouped = rows.groupBy(*[k.alias(n) for k, n in zip(_keys(grain), names)]).agg(*averages)
    label = GRAINS[grain][0]
    value = bucket_value([F.col(n) for n in names], grain).alias(label)
    return grouped.select(value, *[f"avg_{m}" for m in metrics]).orderBy(F.col(label).asc_nulls_last())


def _of_day(parts: DataFrame, date: dt.date | str | None, known_places: bool) -> DataFrame:
    """Partials of a date, by default the newest one that has any."""
    rows = _known(parts, known_places)
    day = rows.agg(F.max("day")).scalar() if date is None else F.lit(parse_date(date))
    return rows.where(F.col("day") == day)


def hourly_average(parts: DataFrame, date: dt.date | str | None = None, digits: int | None = None) -> DataFrame:
    """As ``aggregates.hourly_average``."""
    return (
        _of_day(parts, date, known_places=True)
        .groupBy(F.col("hour").alias("h"))
        .agg(_average("temp", digits).alias("temperature"), _average("humidity", digits).alias("humidity"))
        .orderBy("h")
        .select(hour_label(F.col("h")).alias("hour"), "temperature", "humidity")
    )


def extreme(
    parts: DataFrame, metric: str, how: str, date: dt.date | str | None = None, drop_sentinel: bool = False
) -> DataFrame:
    """As ``aggregates.extreme``."""
    if how not in ("max", "min"):
        raise ValueError(f"how must be 'max' or 'min', not {how!r}")
    rows = _known(parts, drop_sentinel)
    rows = rows if date is None else rows.where(F.col("day") == F.lit(parse_date(date)))
    return rows.agg((F.max if how == "max" else F.min)(f"{metric}.{how}").alias(f"{how}_{metric}"))


def first_per_bucket(
    parts: DataFrame, grain: str, values: list[str], descending: bool = False, n: int | None = None
) -> DataFrame:
    """As ``series.first_per_bucket`` over the time of measurement: the first readings of hours are folded."""
    if grain == "hour_of_day":
        raise ValueError("hour_of_day is not a span of time")
    names = [f"key{i}" for i in range(len(_keys(grain)))]
    firsts = parts.groupBy(*[k.alias(n) for k, n in zip(_keys(grain), names)]).agg(F.min("first").alias("first"))
    bucket = bucket_value([F.col(n) for n in names], grain).alias(grain)
    result = firsts.select(bucket, *[F.col("first")[v].alias(v) for v in values])
    result = result.orderBy(F.col(grain).desc_nulls_last() if descending else F.col(grain).asc_nulls_last())
    return result if n is None else result.limit(n)


def first_per_hour(
    parts: DataFrame, values: list[str], date: dt.date | str | None = None, known_places: bool = False,
    with_date: str | None = None,
) -> DataFrame:
    """As ``series.first_per_hour``."""
    if with_date not in (None, "label", "date"):
        raise ValueError(f"with_date must be None, 'label' or 'date', not {with_date!r}")
    rows = _of_day(parts, date, known_places).groupBy("day", F.col("hour").alias("h"))
    firsts = rows.agg(F.min("first").alias("first")).orderBy("h")
    shown = {None: [], "date": [F.col("day").alias("date")], "label": [date_label(F.col("day")).alias("date")]}
    return firsts.select(
        *shown[with_date], hour_label(F.col("h")).alias("hour"), *[F.col("first")[v].alias(v) for v in values]
    )
