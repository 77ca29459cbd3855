"""Small aggregates beside stored readings, kept per file: made once, extended by new files, refused when files differ.

A summary's rows carry path, length and modification time of the file they were made from. Every use compares them
with a listing of the readings' folder, inside the same plan and without opening a file, and fails if the two differ:
after an append ``extend`` reads the new files alone; files that were rewritten or removed need a new summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ["path", "length", "modified"]

# From readings and the columns that name their file to rows of the summary.
Summarize = Callable[[DataFrame, list[Column]], DataFrame]


def file_columns() -> list[Column]:
    meta = F.col("_metadata")
    return [
        meta["file_path"].alias("path"), meta["file_size"].alias("length"),
        meta["file_modification_time"].alias("modified"),
    ]


def write(spark: SparkSession, readings: str, path: str, summarize: Summarize) -> None:
    """Summarize the readings that ``write_readings`` stored at ``readings`` into a new ``path``."""
    summarize(spark.read.parquet(readings), file_columns()).write.mode("errorifexists").parquet(path)


def files_now(spark: SparkSession, readings: str) -> DataFrame:
    """Path, length and modification time of the readings' files: a listing, no file is opened."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return listing.load(readings).select("path", "length", F.col("modificationTime").alias("modified"))


def _summarized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*FILE).distinct()


def extend(spark: SparkSession, readings: str, path: str, summarize: Summarize) -> None:
    """Add the files that were written since. Older files are pruned by their times, before any is opened."""
    done = _summarized(spark, path)
    newest = done.agg(F.max("modified")).first()[0]
    later = spark.read.parquet(readings)
    if newest is not None:
        # files of the same instant as the last one seen may be new as well
        later = later.where(F.col("_metadata")["file_modification_time"] >= F.lit(newest))
    summarize(later, file_columns()).join(done, FILE, "left_anti").write.mode("append").parquet(path)


def _differs(spark: SparkSession, readings: str, path: str) -> Column:
    """How many files are in only one of summary and folder: a scalar subquery over the two listings."""
    both = files_now(spark, readings).select(*FILE, F.lit(1).alias("side")).unionByName(
        _summarized(spark, path).withColumn("side", F.lit(-1))
    )
    return both.groupBy(*FILE).agg(F.sum("side").alias("side")).where("side <> 0").agg(F.count("*")).scalar()


def read(spark: SparkSession, readings: str, path: str, name: str) -> DataFrame:
    """The summary's rows. Evaluating them fails when the summary, called ``name``, doesn't fit the files."""
    fits = F.when(_differs(spark, readings, path) == 0, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"the {name} is not of these files; extend it or write a new one")).cast("boolean")
    )
    return spark.read.parquet(path).where(fits)
