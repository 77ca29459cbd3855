"""Where a query may write: a folder that the driver and every executor see."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="aneroid-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a ``local[...]`` master.

    Elsewhere a machine's own disk would lose files without an error. So a missing setting raises, and so
    does a ``file:`` folder, unless the whole cluster is on one machine (``local-cluster[...]``).
    """
    return folder_for(spark.conf.get("spark.master", ""), spark.conf.get("spark.checkpoint.dir", None))


def folder_for(master: str, configured: str | None) -> str:
    if configured is None:
        if master == "local" or master.startswith("local["):
            return _local_folder()
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
    if configured.startswith("file:") and not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir {configured!r} is another folder on each machine of {master!r}")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to yet."""
    return f"{shared_folder(spark)}/aneroid/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete everything that queries wrote under the shared folder; false if there was nothing.

    Call it when no result that reads those files is needed any more.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/aneroid")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
