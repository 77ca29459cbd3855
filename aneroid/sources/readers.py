"""Readers. One entry point over the formats the readings are kept in.

Parquet is built into Spark. Delta, JDBC drivers and the Cassandra connector are external jars: without
them Spark's own error about the missing source reaches the caller.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# short name -> Spark source name; any other name is handed to Spark as it is
FORMATS = {
    "delta": "delta",
    "parquet": "parquet",
    "clickhouse": "jdbc",
    "cassandra": "org.apache.spark.sql.cassandra",
}

# Object-store settings by their two usual spellings -> Hadoop S3A property.
STORE_PROPERTIES = {
    "AWS_ACCESS_KEY_ID": "fs.s3a.access.key",
    "AWS_SECRET_ACCESS_KEY": "fs.s3a.secret.key",
    "AWS_ENDPOINT": "fs.s3a.endpoint",
    "AWS_REGION": "fs.s3a.endpoint.region",
    "AWS_S3_ADDRESSING_STYLE": "fs.s3a.path.style.access",
    "s3_access_key_id": "fs.s3a.access.key",
    "s3_secret_access_key": "fs.s3a.secret.key",
    "s3_endpoint": "fs.s3a.endpoint",
    "s3_region": "fs.s3a.endpoint.region",
    "s3_url_style": "fs.s3a.path.style.access",
}


METADATA = "AWS_S3_USE_INSTANCE_METADATA"
# Settings of other writers: how Spark commits files does not depend on it.
WITHOUT_EQUAL = {"AWS_S3_ALLOW_UNSAFE_RENAME"}
PARTITIONING = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def object_store_options(settings: Mapping[str, str]) -> dict[str, str]:
    """Reader options for an S3-compatible store. Empty values are left to the cluster's own settings;
    a setting with no equal is an error, as it would change nothing."""
    options = {}
    for key, value in settings.items():
        prop = STORE_PROPERTIES.get(key)
        if key in WITHOUT_EQUAL or (key == METADATA and value.lower() != "true"):
            continue
        if key == METADATA:
            options["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.auth.IAMInstanceCredentialsProvider"
            continue
        if prop is None:
            raise ValueError(f"unknown store setting {key!r}; expected one of {', '.join(STORE_PROPERTIES)}")
        if value == "":
            continue
        options[prop] = str(value == "path").lower() if prop.endswith("path.style.access") else value
    return options


def clickhouse_options(
    host: str, port: int | str, database: str, user: str, password: str, **options: str
) -> dict[str, str]:
    """JDBC options for ClickHouse: ``query`` for SQL the database runs itself, or ``dbtable``.

    A table is read in parallel, so it needs ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``. Timestamps come without a zone, as they are stored.
    """
    if ("query" in options) == ("dbtable" in options):
        raise ValueError("give either dbtable or query")
    missing = [o for o in PARTITIONING if o not in options]
    if "dbtable" in options and missing:
        raise ValueError(f"reading a table needs {', '.join(missing)}")
    return {
        "url": f"jdbc:clickhouse://{host}:{port}/{database}",
        "driver": "com.clickhouse.jdbc.ClickHouseDriver",
        "user": user,
        "password": password,
        "fetchsize": "100000",
        "preferTimestampNTZ": "true",
        **options,
    }


def cassandra_options(keyspace: str, table: str = "sensor_data_processed", **options: str) -> dict[str, str]:
    return {"keyspace": keyspace, "table": table, **options}


def read_sensor(
    spark: SparkSession, fmt: str, path: str | None = None, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """Readings as a lazy DataFrame; follow with ``normalize`` unless they were stored normalized.

    A known ``schema`` saves the job that would look for one in the files.
    """
    reader = spark.read.format(FORMATS.get(fmt, fmt)).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    if path is None:
        return reader.load()
    return reader.load("s3a://" + path[len("s3://"):] if path.startswith("s3://") else path)


def register(df: DataFrame, name: str = "sensor_data") -> None:
    """Make the readings available to SQL under ``name``."""
    df.createOrReplaceTempView(name)
