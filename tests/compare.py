"""Run a registered query and its SQL twin, and say how the results differ."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_types = {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    got_types = dict(df.dtypes)
    if got_types != want_types:
        return f"schema: {got_types} != {want_types}"
    want = rows_of(rel.columns, rel.fetchall())
    if got != want:
        return f"{sum(got.values())} rows vs {sum(want.values())}; only spark {list((got - want))[:2]}; only sql {list((want - got))[:2]}"
    return None
