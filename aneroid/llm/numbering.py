"""Positions within groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before_bucket(df: DataFrame, key: str, bucket: str, amount: Column, name: str) -> DataFrame:
    """Per (key, bucket): the sum of ``amount`` over the key's earlier buckets.

    The running sum sees one row for each bucket of a key, however many rows the bucket has.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(amount).alias("_num_sum"))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(key, bucket, F.coalesce(F.sum("_num_sum").over(earlier), F.lit(0)).cast("long").alias(name))


def running(df: DataFrame, key: str, bucket: str, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all earlier rows of the key, by (bucket, order).

    Rows are ranked within (key, bucket) only, so a key with a third of all rows is spread over its buckets.
    With amount 1 this numbers the rows of a key from 0 without gaps.
    """
    offsets = before_bucket(df, key, bucket, amount, "_num_offset")
    offsets = offsets.withColumnsRenamed({key: "_num_key", bucket: "_num_bucket"})
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_num_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = ranked.join(offsets, F.col(key).eqNullSafe(F.col("_num_key")) & (F.col(bucket) == F.col("_num_bucket")))
    return joined.withColumn(name, (F.col("_num_offset") + F.col("_num_inside")).cast("long")).drop(
        "_num_key", "_num_bucket", "_num_offset", "_num_inside"
    )


def hash_bucket(*columns: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
