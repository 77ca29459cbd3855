"""How much the vocabularies of sources differ, per language, from texts that are counted once for all their copies.

Identical texts of a language are collapsed to one row with the number of its copies in every source. That row is
split into terms once, and a term adds its count, and one document, once for every copy. Sources are then
compared over the terms that occur in them: a term that is in neither of two sources has one known share in
each, so all such terms together are one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aneroid.llm.slices import added, gather, sliced
from aneroid.llm.words import Words, chunks
from aneroid.scratch import stored

# Bytes that are in no term: ASCII other than letters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

FLUSH_PAIRS = 1 << 20  # (text, term) pairs that a task holds
CELLS = "lang string, source string, term string, n long, df long"


def collapsed(docs: DataFrame) -> DataFrame:
    """One row per language and different text: ``lang``, ``text`` and ``copies``, an array of (source, m).

    NULL in any of the three is the empty string. Copies meet under a 128-bit digest, so a text moves once for
    every task that has it, and no task holds the copies of a text: ``copies`` has an entry per source.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.withColumn("digest", F.md5("text"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    per_source = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("m"))
    copies = per_source.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "m")).alias("copies"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


class _Sums:
    """Sums per (language and source, term) over some texts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.words: list[tuple[np.ndarray, pa.Array]] = []  # hashes and terms, maybe repeated
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, term, occurrences
        self.copies: list[tuple[np.ndarray, np.ndarray]] = []  # per text its groups and their copies
        self.sums: list[tuple[np.ndarray, ...]] = []  # group, term, occurrences, documents

    def add_row(self, lang: str, copies: list[dict]) -> None:
        ids = [self.groups.setdefault((lang, c["source"]), len(self.groups)) for c in copies]
        self.copies.append((np.array(ids, np.int64), np.array([c["m"] for c in copies], np.int64)))

    def add_words(self, rows: np.ndarray, part: Words) -> None:
        hashes, at, term = np.unique(part.hashes, return_index=True, return_inverse=True)
        self.words.append((hashes, gather(part.data, part.starts[at], part.ends[at])))
        pairs, n = np.unique(rows * len(hashes) + term, return_counts=True)
        self.pairs.append((pairs // len(hashes), hashes[pairs % len(hashes)], n))

    def held(self) -> int:
        return sum(len(p[0]) for p in self.pairs)

    def settle(self) -> None:
        """Multiply by the copies. A text that many sources have is spread over several steps."""
        if not self.pairs:
            return
        # slices of one text may repeat a term: one document, all its occurrences
        rows, hashes, counts = map(np.concatenate, zip(*self.pairs, strict=True))
        (rows, hashes), (counts,) = added((rows, hashes), (counts,))
        per_row = np.array([len(ids) for ids, _ in self.copies])
        firsts = np.r_[0, np.cumsum(per_row)]
        ids, ms = (np.concatenate(x) for x in zip(*self.copies, strict=True))
        times = per_row[rows]
        steps = np.cumsum(times) // (4 * FLUSH_PAIRS)
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(steps)) + 1):
            t = times[part]
            at = np.repeat(firsts[rows[part]] - np.r_[0, np.cumsum(t)[:-1]], t) + np.arange(t.sum())
            keys = ids[at], np.repeat(hashes[part], t)
            keys, sums = added(keys, (np.repeat(counts[part], t) * ms[at], ms[at]))
            self.sums.append((*keys, *sums))
        group, term, n, df = map(np.concatenate, zip(*self.sums, strict=True))
        keys, sums = added((group, term), (n, df))
        self.sums = [(*keys, *sums)]
        hashes, at = np.unique(np.concatenate([h for h, _ in self.words]), return_index=True)
        self.words = [(hashes, pa.chunked_array([w for _, w in self.words]).take(pa.array(at)).combine_chunks())]
        self.pairs, self.copies = [], []

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of ``CELLS``; empties the sums."""
        self.settle()
        if self.sums:
            ((group, term, n, df),), ((hashes, words),) = self.sums, self.words
            langs, sources = (pa.array(list(x), pa.string()) for x in zip(*self.groups, strict=True))
            words = words.cast(pa.string())
            for i in range(0, len(group), 1 << 16):
                some = slice(i, i + (1 << 16))
                names = [x.take(pa.array(group[some])) for x in (langs, sources)]
                terms = words.take(pa.array(np.searchsorted(hashes, term[some])))
                yield pa.RecordBatch.from_arrays(
                    [*names, terms, pa.array(n[some]), pa.array(df[some])], names=["lang", "source", "term", "n", "df"]
                )
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        langs, copies = batch.column("lang").to_pylist(), batch.column("copies").to_pylist()
        texts, row_of = sliced(batch.column("text"), NOT_LETTER)
        first = len(sums.copies)
        for lang, some in zip(langs, copies, strict=True):
            sums.add_row(lang, some)
        for part in chunks(texts, NOT_LETTER):
            if len(part.hashes):
                sums.add_words(row_of[part.first + part.rows()] + first, part)
        if sums.held() > FLUSH_PAIRS:
            sums.settle()
            if len(sums.sums[0][0]) > FLUSH_PAIRS:
                yield from sums.batches()
    yield from sums.batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """``CELLS``: per language, source and term its occurrences and its documents, copies included.

    Terms are runs of letters and of characters beyond ASCII; only A-Z is lower-cased. Terms whose 64-bit
    hashes agree within a task would be taken for one. The tasks have added up already, so their rows are dealt by
    language and term: all sources of a term meet.
    """
    parts = collapsed(docs).mapInArrow(_count, CELLS).repartition("lang", "term")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 5) / total), exact beyond 64 bits; NULL where nothing is counted."""
    top = F.lit(scale).cast("decimal(38,0)") * (count.cast("decimal(20,0)") + F.lit(5))
    return F.call_function("div", top, F.nullif(total, F.lit(0)).cast("decimal(20,0)")) + 1


def divergence(
    docs: DataFrame, least_documents: int = 30, top: int = 50, scale: int = 1_000_000_000
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs in ``docs``.

    A language keeps the terms of at least ``least_documents`` of its documents; their smoothed shares in a
    source or language are whole numbers, ``1 + floor(scale * (count + 5) / (N + 5 V))``. Part ``pair``: every other
    source of the language with the sum of absolute differences over all kept terms. Part ``term``: the ``top`` kept
    terms of the source whose share exceeds the language's the most. Ranks go by value, then by the item's bytes.

    NULL in lang, source or text is the empty string. Repeated rows are documents of their own. Documents without a
    term count for their group, which then has N = 0; a language without kept terms has pairs of value 0 and no
    terms. An empty table gives an empty result. ``docs`` may have any other columns, none of which is read.
    """
    per_term = term_counts(docs).groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("cells")
    )
    kept = stored(per_term.filter(F.col("df") >= least_documents).drop("df"), "divergence-terms")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*names).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("all_lang"))
    here = kept.select("lang", "term", "n_lang", F.inline("cells"))
    mine = here.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("terms"))
    groups = groups.join(sizes, "lang", "left").join(mine, ["lang", "source"], "left").na.fill(0)
    total = F.col("all") + 5 * F.col("v")
    groups = groups.withColumn("none", _share(F.lit(0), total, scale))
    groups = stored(groups, "divergence-groups")
    cells = here.join(groups.drop("terms"), ["lang", "source"]).select(
        "lang", "source", "term", "none", _share(F.col("n"), total, scale).alias("p"),
        _share(F.col("n_lang"), F.col("all_lang") + 5 * F.col("v"), scale).alias("q"),
    )
    cells = stored(cells, "divergence-shares")

    pairs = _pairs(cells, groups)
    by_value = [F.col("value").desc(), F.col("item").asc()]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))
    over = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))
    return ranked.unionByName(over.filter(F.col("rank") <= top))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every two sources of a language, both ways, with their distance.

    A term of source a alone adds |p_a - none_b|; one that is in both is corrected for the two sums it is in.
    Only terms that both have are joined.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_b"), F.col("terms").alias("terms_b"))
    # equal shares of a source are compared with another source's `none` once
    shares = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = shares.join(other, "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("none_b"))).alias("alone"))
    b = cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("none").alias("none_b"))
    both = cells.join(b, ["lang", "term"]).filter("source < item")
    both = both.groupBy("lang", "source", "item").agg(
        F.sum(
            F.abs(F.col("p") - F.col("p_b")) - F.abs(F.col("p") - F.col("none_b"))
            - F.abs(F.col("none") - F.col("p_b")) + F.abs(F.col("none") - F.col("none_b"))
        ).alias("both")
    )
    there = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("there"))
    pairs = groups.join(other, "lang").filter("source < item")
    for more in (alone, there, both):
        pairs = pairs.join(more, ["lang", "source", "item"], "left")
    absent = (F.col("v") - F.col("terms") - F.col("terms_b")) * F.abs(F.col("none") - F.col("none_b"))
    sums = [F.coalesce(c, F.lit(0)) for c in (absent, F.col("alone"), F.col("there"), F.col("both"))]
    value = sums[0] + sums[1] + sums[2] + sums[3]
    halves = stored(pairs.select("lang", "source", "item", value.cast("long").alias("value")), "divergence-pairs")
    swapped = halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return halves.unionByName(swapped).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
