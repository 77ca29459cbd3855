"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def bounded(docs: DataFrame, ids: DataFrame, rows: int, megabytes: int, id_col: str = "doc_id") -> list[str]:
    """Whole texts of the documents in ``ids``: at most ``rows``, and at most ``megabytes`` together.

    The rows with the smallest hashes of their ids are taken, so the sample does not depend on order or
    partitioning; equal rows count once. Texts longer than a 32nd of the bytes come last, the shortest first, so
    a few long ones take no room from the others; a text that alone is over the bound is left out, and so are
    NULL ids and texts. Further ids are looked up until the rows or the bytes are reached. The choice is made by
    sizes and hashes: only chosen texts are moved.
    """
    spark, most = docs.sparkSession, megabytes << 20
    rank, size, text_hash = F.xxhash64(F.col(id_col)), F.octet_length("text").cast("long"), F.xxhash64("text")
    ids = ids.filter(F.col(id_col).isNotNull()).select(id_col).distinct().withColumn("_r", rank)
    fits = docs.filter(F.col(id_col).isNotNull() & F.col("text").isNotNull() & (size <= most))
    sizes = fits.select(id_col, rank.alias("_r"), text_hash.alias("_h"), size.alias("_size"))
    late = F.when(F.col("_size") > most // 32, F.col("_size")).otherwise(0)
    found: list[tuple] = []
    within, batch = F.lit(True), rows
    while True:
        upto = ids.filter(within).orderBy("_r").limit(batch).agg(F.max("_r")).first()[0]
        if upto is None:
            break
        within = within & (F.col("_r") <= upto)
        wanted = ids.filter(within).select(id_col)
        wanted = F.broadcast(wanted) if batch <= 8 * rows else wanted
        some = sizes.filter(within).join(wanted, id_col, "left_semi").groupBy("_r", id_col, "_h").agg(F.max("_size").alias("_size"))
        some = some.select(late.alias("_late"), "_r", id_col, "_h", "_size").orderBy("_late", "_r", id_col, "_h").limit(rows)
        found = sorted([*found, *map(tuple, some.collect())])[:rows]
        early = [x[-1] for x in found if not x[0]]
        if len(early) >= rows or sum(early) > most:
            break
        within, batch = F.col("_r") > upto, 4 * batch
    chosen, total = [], 0
    for _, _, i, h, n in found:
        total += n
        if total > most:
            break
        chosen.append((i, h))
    if not chosen:
        return []
    keys = spark.createDataFrame(chosen, StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("_h", LongType())]))
    texts = fits.select(id_col, text_hash.alias("_h"), "text").join(F.broadcast(keys), [id_col, "_h"], "left_semi")
    text_of = {(r[0], r[1]): r[2] for r in texts.groupBy(id_col, "_h").agg(F.max("text")).collect()}
    return [text_of[k] for k in chosen]


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, side: Column, rows: int, megabytes: int
) -> list[str]:
    return bounded(docs, labels.filter(F.col(label).isNotNull() & side), rows, megabytes)
