"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aneroid.llm.numbering import hash_bucket, running
from aneroid.scratch import stored

# 2 ** 32 times the golden ratio's fractional part, as an integer (fixed value)
GOLDEN = 2654435769
CELLS = 1024


def targets(sizes: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Words to take from each source: ``source, source_size`` -> also ``weight, target, quota``.

    Sources are sorted by code point, NULL last, and weigh ``weights`` in turn. All targets together are
    ``share`` of all words; a target stops at ``most`` times its source, and the excess goes to the others by
    weight until none is above: target = min(most * size, level * weight), with the one level that gives the
    total. The windows are over one row per source. ``quota`` is the target in whole words.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(cycle, F.col("_rank") % len(weights))
    )
    rows = rows.withColumn("_cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    full = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * float(share)
    level = (total - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))) / F.sum("weight").over(left)
    rows = rows.withColumn("_level", level)
    fits = F.col("_level") <= F.col("_cap") / F.col("weight")
    rows = rows.withColumn("_level", F.min_by(F.when(fits, F.col("_level")), F.when(
        fits, F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"))
    )).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return rows.withColumn("target", target).withColumn("quota", F.round("target").cast("long")).drop(
        "_rank", "_cap", "_level"
    )


def schedule(plan: DataFrame, block_words: Column | int) -> DataFrame:
    """The slots of the mix: ``slot, source, rank, epoch, block, words``.

    ``plan`` has ``source, source_size, quota``. Slot i looks at the golden-ratio point frac(i * 0.618...),
    finds the source in whose share of all slots it falls, and takes that source's next block, so that every
    stretch of the schedule has each source near its share. A source that got its quota before the end skips
    the slot; one that is still short gets its last blocks after the end. A source begins again when its
    blocks are used up; its last slot is cut, so that the words of its slots add up to its quota.
    """
    spark = plan.sparkSession
    size, words = F.col("source_size"), F.col("_block_words")
    per_epoch = F.ceil(size / words)
    rows = plan.withColumn("_block_words", F.lit(block_words) if isinstance(block_words, int) else block_words)
    rows = rows.filter("quota > 0").withColumn("_per_epoch", per_epoch.cast("long")).withColumn(
        "_slots",
        (F.floor(F.col("quota") / size) * F.col("_per_epoch") + F.ceil((F.col("quota") % size) / words)).cast("long"),
    )
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_to": F.sum("_slots").over(upto),
        "_all": F.sum("_slots").over(Window.partitionBy()),
    })
    rows = rows.withColumns({"_from": (F.col("_to") - F.col("_slots")) / F.col("_all"), "_to": F.col("_to") / F.col("_all")})
    rows = stored(rows, "mix-plan")
    total = rows.agg(F.max("_all")).first()[0] or 0

    # points meet intervals by the cells of [0, 1) that they lie in: an equi-join, and no side needs to be small
    point = (F.col("id") % (1 << 31)) * F.lit(GOLDEN) % (1 << 32) / F.lit(float(1 << 32))
    points = spark.range(total).select(F.col("id").alias("slot"), point.alias("_point")).withColumn(
        "_cell", F.floor(F.col("_point") * CELLS).cast("int")
    )
    first, last = F.floor(F.col("_from") * CELLS), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1))
    intervals = rows.withColumn("_cell", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    hits = points.join(intervals, "_cell").filter("_point >= _from AND _point < _to")
    hits = running(
        hits.withColumn("_chunk", F.floor(F.col("slot") / 65536)), "source", "_chunk", [F.col("slot")], F.lit(1), "rank"
    )
    details = ["source", "source_size", "quota", "_block_words", "_per_epoch"]
    hits = hits.filter("rank < _slots").select("slot", "rank", *details)
    got = hits.groupBy("source").agg(F.count("*").alias("_got")).withColumnRenamed("source", "_source")
    short = rows.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").filter(
        F.coalesce("_got", F.lit(0)) < F.col("_slots")
    ).withColumn("rank", F.explode(F.sequence(F.coalesce("_got", F.lit(0)), F.col("_slots") - 1)))
    slots = hits.unionByName(short.select((F.lit(total) + F.col("rank")).alias("slot"), "rank", *details))

    epoch, block = F.floor(F.col("rank") / F.col("_per_epoch")), F.col("rank") % F.col("_per_epoch")
    begin = block * F.col("_block_words")
    length = F.least(
        F.col("_block_words"), size - begin, F.col("quota") - epoch * size - begin
    )
    return slots.select(
        "slot", "source", "rank", epoch.cast("long").alias("epoch"), block.cast("long").alias("block"),
        length.cast("long").alias("words"), F.col("_block_words").cast("long").alias("block_words"),
    )


def mix(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float],
    share: float = 1.0,
    most: float = 3.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    blocks: int = 1 << 18,
    buckets: int = 1024,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Mixes sources: per document what the mix takes, and the schedule.

    A source's documents are shuffled by a hash of their id and laid end to end; its words are cut into
    blocks of one length for all sources (all words / ``blocks``, at least 64), and ``schedule`` deals the
    blocks out. Returns

    - ``id_col, size, source, source_size, target, first_word, taken``: ``first_word`` is the document's place
      in its source, ``taken`` the words the mix takes from it, repeats counted;
    - the slots of ``schedule``.

    A NULL source is a source; NULL ids are shuffled together; a NULL size counts as 0. Repeated rows are
    separate documents. An empty table, or one without words, gives nothing to take. Only the id, the source
    and the size are shuffled, never texts. The result depends on ids, sources and sizes alone.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    )
    narrow = stored(narrow.withColumn("_bucket", hash_bucket(F.lit(seed), "doc_id", buckets=buckets)), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    block_words = F.greatest(F.lit(64), F.ceil(F.sum("source_size").over(Window.partitionBy()) / blocks)).cast("long")
    plan = stored(plan.withColumn("_block_words", block_words), "mix-targets")
    slots = stored(schedule(plan, F.col("_block_words")), "mix-schedule")

    # taken(x): words taken from the first x words of a source, so a document takes taken(end) - taken(start)
    takes = slots.groupBy("source", "block").agg(
        F.sum("words").alias("_block_taken"), F.collect_list("words").alias("_takes")
    )
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    takes = takes.select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), "_takes",
        F.coalesce(F.sum("_block_taken").over(earlier), F.lit(0)).alias("_before"),
    )
    takes = stored(takes, "mix-takes")
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id"), F.col("size")]
    placed = running(narrow, "source", "_bucket", order, F.col("size"), "first_word").drop("_bucket")
    facts = plan.select(F.col("source").alias("_p"), "source_size", "target", "_block_words")
    placed = placed.join(facts, F.col("source").eqNullSafe(F.col("_p"))).drop("_p")
    for name, at in (("_t0", F.col("first_word")), ("_t1", F.col("first_word") + F.col("size"))):
        # the end of the last document may begin a block of its own; it then belongs to the block before
        block = F.floor(F.greatest(at - F.lit(1), F.lit(0)) / F.col("_block_words"))
        placed = placed.withColumns({"_at": at, "_block": block}).join(
            takes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left"
        )
        inside = F.col("_at") - F.col("_block") * F.col("_block_words")
        upto = F.aggregate("_takes", F.lit(0).cast("long"), lambda s, t: s + F.least(inside, t))
        placed = placed.withColumn(name, F.col("_before") + upto).drop(
            "_s", "_b", "_takes", "_before", "_at", "_block"
        )
    # a source's first blocks are taken; behind the last of them nothing is added
    ends = slots.groupBy(F.col("source").alias("_s")).agg(F.sum("words").alias("_all"))
    placed = placed.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
    everything = F.coalesce("_all", F.lit(0))
    taken = F.coalesce("_t1", everything) - F.coalesce("_t0", everything)
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", "first_word",
        taken.cast("long").alias("taken"),
    ), slots
