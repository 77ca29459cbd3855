"""Ad-hoc SQL over the readings, and their schema."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def describe(df: DataFrame) -> DataFrame:
    """Columns and types, as rows ``(col_name, data_type, comment)``."""
    return df.sparkSession.sql("DESCRIBE QUERY SELECT * FROM {readings}", readings=df)


def schema_text(df: DataFrame) -> str:
    """One line ``name (TYPE)`` per column."""
    return "\n".join(f"{f.name} ({f.dataType.simpleString().upper()})" for f in df.schema.fields)


# The number codes of strftime, and what they show of a time without a zone. Codes that are names
# of days or months, or that depend on a locale, are errors.
STRFTIME_CODES = {
    "%Y": "lpad(cast(year(moment) AS string), 4, '0')",
    "%y": "lpad(cast(year(moment) % 100 AS string), 2, '0')",
    "%m": "lpad(cast(month(moment) AS string), 2, '0')",
    "%d": "lpad(cast(day(moment) AS string), 2, '0')",
    "%j": "lpad(cast(dayofyear(moment) AS string), 3, '0')",
    "%H": "lpad(cast(hour(moment) AS string), 2, '0')",
    "%M": "lpad(cast(minute(moment) AS string), 2, '0')",
    "%S": "lpad(cast(second(moment) AS string), 2, '0')",
    "%f": "lpad(cast(cast(extract(SECOND FROM moment) * 1000000 AS bigint) % 1000000 AS string), 6, '0')",
}


def add_label_function(spark: SparkSession) -> None:
    """Let SQL of this session label times as ``strftime(timestamp, '%Y-%m-%d %H:00')``.

    A temporary SQL function: the optimizer replaces it by its expressions, so labels need no UDF and do not depend
    on the session zone. A function of that name that is already there is left as it is.
    """
    if spark.catalog.functionExists("strftime"):
        return
    text = "replace(form, '%%', chr(1))"
    for code, shown in STRFTIME_CODES.items():
        text = f"replace({text}, '{code}', {shown})"
    spark.sql(f"""
        CREATE TEMPORARY FUNCTION strftime(moment TIMESTAMP_NTZ, form STRING) RETURNS STRING RETURN
        CASE WHEN contains({text}, '%') THEN raise_error(concat('strftime does not know all codes of ', form))
             ELSE replace({text}, chr(1), '%') END
    """)


def run_sql(spark: SparkSession, df: DataFrame, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run SQL in which the readings are called ``sensor_data``; a view of that name is left as it is.

    Values belong in ``args`` as named parameters (``:name``); times are labelled by ``strftime``. Trailing semicolons are dropped. Mixed
    TIMESTAMP and TIMESTAMP_NTZ expressions follow the session zone; keep it at UTC.
    """
    add_label_function(spark)
    own = f"sensor_data_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(own)
    try:
        return spark.sql(f"WITH sensor_data AS (SELECT * FROM {own}) {_body(sql)}", args=args)
    finally:
        spark.catalog.dropTempView(own)


def _body(sql: str) -> str:
    """The statement in a form that may follow a common table expression."""
    text = sql.strip("; \t\r\n")
    return f"SELECT * FROM (\n{text}\n)"
