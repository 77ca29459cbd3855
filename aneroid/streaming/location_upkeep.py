"""Keep the location index current as readings arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aneroid.operators.location_index import clustering_order, location_rows, publish, published


def write_load(batch: DataFrame, path: str, name: str) -> None:
    """One load of the index. A load that is on the list is left as it is, so a retried batch changes nothing.

    What a failed try has left of an unlisted load, and no lookup reads, is replaced.
    """
    spark = batch.sparkSession
    if not _is_published(batch, path, name):
        location_rows(batch).orderBy(*clustering_order()).write.mode("overwrite").parquet(f"{path}/load={name}")
        publish(spark, path, name)


def _is_published(batch: DataFrame, path: str, name: str) -> bool:
    try:
        return not published(batch.sparkSession, path).where(F.col("load") == name).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":  # the first load of an index without a base
            return False
        raise


def maintain_location_index(
    readings: DataFrame, path: str, checkpoint: str, trigger: dict[str, object] | None = None
) -> StreamingQuery:
    """Start a query that adds each batch of ``readings`` to the index at ``path``.

    A batch costs what the batch holds, not what the index or a busy station holds: nothing stored is
    rewritten, and lookups take the latest row per key. Late readings are ordered by ``processed_at``
    like all others, so the result equals a full rebuild. Loads are named by query and batch: a restart
    from the checkpoint replaces the batch it had not finished, a new query adds to what is there. Compactions
    may run at any time.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_load(batch, path, f"{query}-{batch_id:012d}")

    writer = readings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
