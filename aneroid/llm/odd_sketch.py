"""MinHash near-duplicates: banded candidates, checked by odd sketches, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aneroid.llm.components import components
from aneroid.llm.words import Words, chunks, mix
from aneroid.scratch import stored

SHINGLE = 5
CLASS = "struct<doc_id: bigint, h1: bigint>"
BANDS, ROWS = 36, 4  # a pair at 0.75 shares no band with probability 1e-6
SAMPLES = 256  # of which the first BANDS * ROWS are banded, and all are folded into the sketch
SKETCH_BITS = 1024
# Pairs whose estimate is below go no further. At 256 samples the estimate of a true 0.75 has a standard
# deviation of about 0.03 from sampling and parity together, so 0.58 is more than five of them away.
LEAST_ESTIMATE = 0.58
# A bucket of up to this many classes gives all its pairs; for a larger one see ``near_duplicates``.
SMALL_BUCKET = 24
# Sketches of classes that large buckets leave open: their deviation at 0.75 is about 0.011.
PRECISE_SAMPLES, PRECISE_BITS, PRECISE_LEAST = 2048, 8192, 0.69

_MULTIPLY = (mix(np.arange(1, PRECISE_SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_XOR = mix(np.arange(10_001, 10_001 + PRECISE_SAMPLES, dtype=np.uint64)).astype(np.uint32)
_PLACE = mix(np.arange(5000, 5000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their bounds.

    A shingle is five consecutive words; a row with fewer has its whole sequence as one shingle, a row without
    words none.
    """
    n = len(words.hashes)
    counts = np.diff(words.bounds)
    long = counts >= SHINGLE
    sums = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        sums += words.hashes[i : i + len(sums)] * _PLACE[i]
    sums = mix(sums)
    sets, bounds = [], [0]
    for a, count, enough in zip(words.bounds[:-1].tolist(), counts.tolist(), long.tolist(), strict=True):
        if enough:
            s = np.sort(sums[a : a + count - SHINGLE + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif count:
            s = mix(np.array([(words.hashes[a : a + count] * _PLACE[:count]).sum() + np.uint64(count)], np.uint64))
        else:
            s = sums[:0]
        sets.append(s)
        bounds.append(bounds[-1] + len(s))
    return np.concatenate(sets), np.array(bounds)


def min_hashes(shingles: np.ndarray, bounds: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Rows x samples: for each row with shingles the least value of each of the hash functions."""
    filled = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, samples), np.uint32)
    if not len(filled):
        return out
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    starts = bounds[filled]
    # pieces that stay in the processor's cache
    edges = [0]
    while edges[-1] < len(starts):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(starts, starts[edges[-1]] + 32768))))
    for a, b in zip(edges, edges[1:], strict=False):
        end = bounds[filled[b - 1] + 1]
        part, at = base[starts[a] : end], starts[a:b] - starts[a]
        for k in range(samples):
            out[filled[a:b], k] = np.minimum.reduceat((part ^ _XOR[k]) * _MULTIPLY[k], at)
    return out


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Rows x (bits / 8) bytes: a bit is the parity of the number of samples that fall on it.

    Equal samples of two rows flip equal bits, so the bits that differ come from the unequal samples alone.
    """
    rows, n = samples.shape
    numbered = samples.astype(np.uint64) | (np.arange(n, dtype=np.uint64) << np.uint64(32))
    bit = (mix(numbered) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount((bit + np.arange(rows)[:, None] * bits).ravel(), minlength=rows * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(rows, bits), axis=1)


def estimate(differing: Column, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> Column:
    """Similarity of two sets from the number of bits in which their odd sketches differ."""
    share = F.least(F.lit(2.0) * differing / bits, F.lit(1 - 1e-9))
    unequal = F.log(1 - share) / F.log(F.lit(1 - 2.0 / bits))
    return 1 - unequal / (2 * samples)


def differing_bits(left: str, right: str) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _whole(shingles: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit sum over each set: equal for equal sets, and independent for each salt."""
    totals = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(salt * 0x9E3779B9)))])
    return (totals[bounds[1:]] - totals[bounds[:-1]]).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in chunks(batch.column(1)):
            shingles, bounds = shingle_sets(words)
            size = np.diff(bounds)
            samples = min_hashes(shingles, bounds)
            sketch = odd_sketches(samples).view(np.int64)
            bands = np.zeros((len(size), BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(len(size), b, np.uint64)
                for r in range(ROWS):
                    key = mix(key + samples[:, b * ROWS + r])
                bands[:, b] = key
            whole = [_whole(shingles, bounds, salt) for salt in (1, 2)]
            rows = slice(words.first, words.first + len(size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[rows], pa.array(size, pa.int64()), *map(pa.array, whole),
                 _lists(sketch), _lists(bands.view(np.int64))],
                names=["doc_id", "n_shingles", "h1", "h2", "sketch", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in chunks(batch.column(1)):
            shingles, bounds = shingle_sets(words)
            column = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(shingles.view(np.int64)))
            rows = slice(words.first, words.first + len(bounds) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[rows], pa.array(_whole(shingles, bounds, 1)), column], names=["doc_id", "h1", "shingles"]
            )


def _precise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large sketches of sets that were made already."""
    for batch in batches:
        column = batch.column(1)
        bounds = np.asarray(column.offsets)
        shingles = np.asarray(column.values)[bounds[0] : bounds[-1]].view(np.uint64)
        bounds, out = bounds - bounds[0], []
        for a in range(0, len(batch), 512):
            b = min(len(batch), a + 512)
            part = shingles[bounds[a] : bounds[b]]
            samples = min_hashes(part, bounds[a : b + 1] - bounds[a], PRECISE_SAMPLES)
            out.append(odd_sketches(samples, PRECISE_BITS).view(np.int64))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.concatenate(out))], names=["class", "s"])


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i) for i in (2, 3))
            lo, ro = (np.asarray(c.offsets) for c in (left, right))
            lv, rv = (np.asarray(c.values) for c in (left, right))
            good = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                both = np.intersect1d(a, b, assume_unique=True).size
                good[i] = both > 0 and denominator * both >= numerator * (a.size + b.size - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(good)], names=["a", "b", "linked"]
            )

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked at ``percent`` similarity, directly or by others.

    Words are runs of non-space, A-Z lower-cased; a document's set has its distinct five-word shingles (all
    words as one shingle where there are fewer). ``component_id`` is the smallest id that can be reached.

    1. One pass makes per document 256 MinHash samples, their odd sketch and 36 band keys. Documents with
       equal sets become one class, represented by the smallest id, so exact copies cost one row each.
    2. Classes that share a band key are candidates. A large bucket isn't expanded into pairs: each of its
       classes is first compared with its smallest one only, which links most copies of one text.
    3. Where a large bucket still has classes that aren't linked, these are compared exactly: a pair above the
       threshold must share one of each set's rarest shingles (about the first quarter, by document
       frequency), so candidates are the classes with different labels under such a shingle. Passages that
       many documents share are common shingles and make no candidates here.
    4. A candidate pair is dropped if its odd sketches say it is far below; all others are confirmed on the
       full sets, which are made again for candidate classes only.

    Nulls: a NULL id is a document of its own group (component NULL); NULL or blank texts have no shingles and
    link with nothing. Rows that repeat an id are one document if their sets are equal; with different sets,
    all of them belong to that id's component. Empty tables give an empty frame. Links found depend on the
    bands: a pair at exactly 75 % shares none with probability 1e-6.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = source.mapInArrow(
        _signatures, "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>, bands array<long>"
    )
    signatures = stored(made, "near-signatures")
    filled = signatures.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        filled.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "near-classes"
    )
    key = ["n_shingles", "h1", "h2"]
    members = filled.select("doc_id", *key).join(classes, key).filter("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")
    )
    # the representative's own row; two rows with one id and different sets are two classes with one label
    reps = filled.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").dropDuplicates(
        [*key, "doc_id"]
    ).select(F.struct("doc_id", "h1").alias("class"), "doc_id", "n_shingles", "sketch", "bands")
    banded = reps.select("class", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(banded.join(shared, "band"), "near-buckets")
    candidates = buckets.select("class").distinct()
    sketches = stored(reps.select("class", "n_shingles", "sketch").join(candidates, "class", "left_semi"), "near-sketches")
    texts = source.join(
        candidates.select(F.col("class.doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    sets = _class_sets(texts, sketches)
    links = _links(_first_pairs(buckets), sketches, sets, percent)
    labels = stored(
        buckets.select("class").distinct().join(
            components(links).withColumnRenamed("node", "class"), "class", "left"
        ).select("class", F.coalesce("component", "class").alias("label")), "near-labels",
    )
    open_ = _open_classes(buckets, labels)
    if not open_.isEmpty():
        named = _prefixes(open_, sets, percent)
        pairs = _open_pairs(named, _precise_sketches(open_, sets, sketches), percent)
        links = links.unionByName(_links(pairs, sketches, sets, percent))
    edges = members.unionByName(links.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")))
    final = components(edges).withColumnRenamed("node", "doc_id")
    return signatures.select("doc_id", "n_shingles").join(final, "doc_id", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs of small buckets; in a large one, each class with the bucket's smallest."""
    small = buckets.filter(F.col("size") <= SMALL_BUCKET)
    other = small.select("band", F.col("class").alias("b"))
    pairs = small.select("band", F.col("class").alias("a")).join(other, "band").filter("a < b").select("a", "b")
    large = buckets.filter(F.col("size") > SMALL_BUCKET)
    pivots = large.groupBy("band").agg(F.min("class").alias("a"))
    stars = large.join(pivots, "band").filter("a < class").select("class", "a").groupBy("class").agg(
        F.min("a").alias("a")
    )
    return pairs.distinct().unionByName(stars.select("a", F.col("class").alias("b"))).distinct()


def _open_classes(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``class, label`` of the classes in large buckets that hold more than one label."""
    named = buckets.filter(F.col("size") > SMALL_BUCKET).join(labels, "class").select("band", "class", "label")
    ends = named.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m")
    return stored(named.join(ends, "band", "left_semi").select("class", "label").distinct(), "near-open")


def _prefixes(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``band, class, label, n, prefix``: each class under the rarest of its shingles, without those that no other class has.

    With sets sorted by (frequency, shingle), two sets of similarity p share an element of their first
    n - ceil(p * n) + 1. Elements of one class only come first and are counted, not moved.
    """
    rows = sets.join(open_, "class").select(
        "class", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("band")
    )
    frequency = rows.groupBy("band").agg(F.count("*").alias("f")).filter("f > 1")
    shared = stored(rows.join(frequency, "band"), "near-prefixes")
    own = shared.groupBy("class").agg(F.count("*").alias("_shared"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1 - (F.col("n") - F.col("_shared"))
    nth = F.row_number().over(Window.partitionBy("class").orderBy("f", "band"))
    kept = shared.join(own, "class").withColumn("_nth", nth).filter(F.col("_nth") <= first)
    prefix = F.collect_list("band").over(Window.partitionBy("class")).alias("prefix")
    return kept.select("band", "class", "label", "n", prefix)


def _precise_sketches(open_: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    made = sets.join(open_, "class", "left_semi").mapInArrow(_precise, f"class {CLASS}, s array<long>")
    return stored(made.join(sketches.select("class", F.col("sketch").alias("c")), "class"), "near-precise")


def _open_pairs(named: DataFrame, precise: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes under one band that have different labels and pass by size and large sketch.

    Under each band the label with the most classes is the main one; pairs always have a class outside of it,
    so classes that are linked already don't meet. The join itself compares the sketches, under the first
    shingle that both prefixes have, so that a pair is one row, and none if it is well below the threshold.
    """
    counts = named.groupBy("band", "label").agg(F.count("*").alias("n"))
    mains = counts.groupBy("band").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")
    ).filter("labels > 1").select("band", "main")
    open_ = stored(named.join(mains, "band").join(precise, "class"), "near-named")
    outside = open_.filter("label <> main").select(
        "band", F.col("class").alias("a"), "label", F.col("n").alias("n_a"), F.col("c").alias("c_a"),
        F.col("s").alias("s_a"), F.col("prefix").alias("p_a"),
    )
    others = open_.select(
        F.col("band").alias("_band"), F.col("class").alias("b"), F.col("label").alias("other"), "main",
        F.col("n").alias("n_b"), F.col("c").alias("c_b"), F.col("s").alias("s_b"),
        F.col("prefix").alias("p_b"),
    )
    once = F.array_min(F.array_intersect("p_a", "p_b")) == F.col("band")
    # cheap tests first
    coarse = estimate(differing_bits("c_a", "c_b")) >= LEAST_ESTIMATE
    near = estimate(differing_bits("s_a", "s_b"), PRECISE_SAMPLES, PRECISE_BITS) >= PRECISE_LEAST
    new = F.expr("label <> other AND (other = main OR a < b)")
    pairs = outside.join(others, (F.col("band") == F.col("_band")) & new & _sizes_allow(percent) & once & coarse & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches let pass and their full sets confirm."""
    near = stored(_estimated(pairs, sketches, percent), "near-pairs")
    return stored(_confirmed(near, sets, percent).filter("linked").select("a", "b"), "near-confirmed")


def _sizes_allow(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose odd sketches don't rule it out."""
    for side in ("a", "b"):
        facts = sketches.select(
            F.col("class").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")
        )
        pairs = pairs.join(facts, side)
    return pairs.filter(_sizes_allow(percent) & (estimate(differing_bits("s_a", "s_b")) >= LEAST_ESTIMATE)).select("a", "b")


def _class_sets(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """The full sets of the candidate classes, made once more from their texts and written."""
    made = texts.mapInArrow(_sets, "doc_id long, h1 long, shingles array<long>")
    made = made.select(F.struct("doc_id", "h1").alias("class"), "shingles")
    return stored(made.join(sketches.select("class"), "class", "left_semi").dropDuplicates(["class"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b")
    return both.mapInArrow(_confirm(percent, 100), f"a {CLASS}, b {CLASS}, linked boolean")
