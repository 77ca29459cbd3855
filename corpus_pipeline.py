"""The corpus pipeline: from raw documents to shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; the last one adds where
each document goes. ``run`` chains them over the documents, with each stage's result written to the shared
folder. There is no SQL for the whole, as the first stage is a trained model; tests compare the others with
brute force, stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aneroid.llm import compression, hash_tree, mixing, odd_sketch
from aneroid.llm.queries import contaminated_documents, count_words, fit_toxicity, table
from aneroid.scratch import stored

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below a half; a NULL or empty text stays."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    kept = docs.withColumn("_toxic", compression.score(docs, model)).filter("_toxic < 0.5")
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    If rows repeat that id, also with different texts, the one with the smallest text stays (then the smallest
    other columns, in their order). Documents without words are in no group and stay, and so do
    those without an id.
    """
    near = odd_sketch.near_duplicates(docs)
    gone = near.filter("component_id <> doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = near.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    single = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    smallest = F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    once = again.filter(count_words() > 0).groupBy("doc_id").agg(smallest.alias("_row"))
    once = once.select("doc_id", "_row.*").select(*docs.columns)
    return single.unionByName(once).unionByName(again.filter(count_words() == 0))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth is in benchmark passages.

    NULL and empty texts stay, repeated rows are judged alike, and columns named like the operator's are kept.
    """
    own = docs.toDF(*[c if c == "text" else f"_own_{c}" for c in docs.columns])
    found = contaminated_documents(own, table(spark, sf_dir, "benchmark"), own.columns)
    return found.filter(~F.col("contaminated")).select(*own.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words by its words, rounded.

    Sources weigh 5, 2, 1, ... by name and share all words; a source is taken three times at most, and one
    above its target loses documents. A document without words has nothing to take and stays once.
    """
    placed, _ = mixing.mix(docs, count_words(), weights=(5, 2, 1), share=1.0, most=3.0)
    same = ["doc_id", "source", "_size"]
    # rows with one id, source and size (such as rows without an id) are matched one to one
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("text"))
    left = docs.withColumn("_size", count_words())
    left = left.filter("_size > 0").withColumn("_nth", nth)
    right = placed.filter("size > 0").withColumnRenamed("size", "_size").withColumn(
        "_nth", F.row_number().over(Window.partitionBy(*same).orderBy("first_word"))
    )
    copies = F.round(F.col("taken") / F.col("_size")).cast("int")
    right = right.select(*[F.col(c).alias(f"_m{c}") for c in (*same, "_nth")], copies.alias("_copies")).filter(
        "_copies > 0"
    )
    match = F.lit(True)
    for c in (*same, "_nth"):
        match = match & F.col(c).eqNullSafe(F.col(f"_m{c}"))
    taken = left.join(right, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    empty = docs.filter(count_words() == 0)
    return taken.select(*docs.columns).unionByName(empty.select(*docs.columns))


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return hash_tree.shard(docs, "doc_id", hash_tree.regular_tree(SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

# Not in SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages: their columns, ``shard`` and ``slot``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
