"""Personal data: patterns of characters find the plain cases, and the words before those find more.

Every span that the patterns of characters find is a seed of its kind. The two words before a seed are a lexical
pattern; other tokens with a digit or an @ that follow the same words are unseen instances. Spark scores the graph of
lexical patterns and instances in turns: a pattern by how many of its occurrences hold instances of a kind, an unseen
instance by the patterns it occurs in, until no score moves. Instances that score high in a pattern that many
different seeds vouch for are spans of that kind, too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aneroid.scratch import stored

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the contract's patterns: they match the same and never go back over a long run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+")
_EDGES = "()[]{}<>\"'.,;:!?#*="
CONTEXT = 80  # characters in which the two words before a span are looked for


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19:
            doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
            if (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0:
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)`` in code points, in that order."""
    found = zip(range(4), (emails, ips, cards, phones), strict=True)
    return sorted((start, kind, end) for kind, find in found for start, end in find(text))


def unseen(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @, less punctuation at their edges, that touch no span."""
    at, covered = 0, 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][0] < end:
            covered = max(covered, spans[at][2])
            at += 1
        if covered > start:
            continue
        token = m[0]
        start += len(token) - len(token.lstrip(_EDGES))
        token = token.strip(_EDGES)
        if len(token) >= 4:
            yield start, start + len(token)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def context(text: str, start: int) -> str:
    """The two words before the position, lower-cased and with 0 for every digit."""
    return re.sub("[0-9]", "0", " ".join(text[max(0, start - CONTEXT) : start].lower().split()[-2:]))


FOUND = "array<struct<start:long,end:long,kind:int,pattern:long,instance:long>>"
_ENTRY = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("pattern", pa.int64()), ("instance", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            all_ = [(s, e, k) for s, k, e in spans] + [(s, e, -1) for s, e in unseen(text, spans)]
            rows.append([
                {"start": s, "end": e, "kind": k, "pattern": _hash(context(text, s)), "instance": _hash(text[s:e].lower())}
                for s, e, k in all_
            ])
        found = pa.array(rows, pa.list_(_ENTRY))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[batch.schema.names[0], "found"])


def occurrences(docs: DataFrame, id_col: str) -> DataFrame:
    """Per row of ``docs`` its id, a number of its own and ``found``: seeds with their kind, unseen instances with -1."""
    rows = docs.select(id_col, "text")
    found = rows.mapInArrow(_find, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, found {FOUND}")
    return stored(found.select(F.col(id_col), "found", F.monotonically_increasing_id().alias("row")), "personal-found")


def graph(found: DataFrame) -> DataFrame:
    """Edges: how often each instance of each kind (-1: unseen) occurs in each pattern."""
    each = found.select(F.inline("found"))
    return each.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))


def confident(edges: DataFrame, least: float = 0.5, seeds: int = 3, tolerance: float = 1e-3) -> DataFrame:
    """``pattern, instance, kind`` of the accepted unseen instances.

    A seed scores 1 for its kind. A pattern's score for a kind is the sum of its instances' scores, by occurrences,
    over all its occurrences and ``seeds`` more; an unseen instance's is the mean of its patterns' scores by
    occurrences. Rounds go on until no score moves by ``tolerance``; as each passes on only a part, they end. A
    pattern takes part with ``seeds`` different seeds of the kind, and accepts from a score of ``least``, as an instance does; an
    instance has the kind with its highest score, the first listed among equals.
    """
    edges = stored(edges, "personal-edges")
    known = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(
        F.sum("n").cast("double").alias("hits"), F.count("*").alias("different")
    )
    known = known.filter(F.col("different") >= seeds).drop("different")
    total = edges.groupBy("pattern").agg(F.sum("n").alias("of"))
    known = known.join(total, "pattern")
    # only unseen instances that share a pattern with a seed can score
    open_ = edges.filter("kind = -1").select("pattern", "instance", "n")
    of_instance = open_.groupBy("instance").agg(F.sum("n").alias("seen"))
    links = open_.join(known.select("pattern", "kind"), "pattern").join(of_instance, "instance")
    links = stored(links.select("pattern", "instance", "kind", "n", "seen"), "personal-links")
    base = known.withColumn("p", F.col("hits") / (F.col("of") + seeds))
    patterns = stored(base, "personal-patterns")
    while True:
        shares = links.join(patterns.select("pattern", "kind", "p"), ["pattern", "kind"])
        instances = shares.groupBy("instance", "kind").agg((F.sum(F.col("n") * F.col("p")) / F.max("seen")).alias("s"))
        instances = stored(instances, "personal-instances")
        more = links.join(instances, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("s")).alias("more"))
        after = patterns.join(more, ["pattern", "kind"], "left").withColumn(
            "q", (F.col("hits") + F.coalesce("more", F.lit(0.0))) / (F.col("of") + seeds)
        )
        after = stored(after.drop("more"), "personal-patterns")
        moved = after.agg(F.max(F.col("q") - F.col("p"))).first()[0]
        patterns = after.drop("p").withColumnRenamed("q", "p")
        if moved is None or moved < tolerance:
            break
    best = instances.groupBy("instance").agg(F.max(F.struct("s", (-F.col("kind")).alias("k"))).alias("best"))
    best = best.select("instance", F.col("best.s").alias("s"), (-F.col("best.k")).alias("kind")).filter(F.col("s") >= least)
    good = links.join(patterns.filter(F.col("p") >= least).select("pattern", "kind"), ["pattern", "kind"])
    return good.join(best, ["instance", "kind"]).select("pattern", "instance", "kind").distinct()


SALTS = 16


def personal_data(docs: DataFrame, id_col: str = "doc_id", least: float = 0.5, seeds: int = 3) -> DataFrame:
    """Per row of ``docs``: its id, ``base`` and ``spans``, both arrays of (start, kind, end) in order.

    ``base`` are the spans of the patterns of characters; ``spans`` has those that the words before them lead to
    as well. Offsets are code points, ends exclusive; ``kind`` is a position in ``KINDS``. NULL and empty texts
    have none. Every row is judged by itself, so ids may be NULL or repeat; repeated texts count as often as they
    occur. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    found = occurrences(docs, id_col)
    accepted = stored(confident(graph(found), least, seeds), "personal-accepted")
    salted = accepted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    new = found.select("row", F.inline("found")).filter("kind = -1").drop("kind")
    new = new.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    new = new.join(salted, ["pattern", "instance", "salt"]).groupBy(F.col("row").alias("new_row")).agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("new")
    )
    base = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    base = F.array_sort(base).cast("array<struct<start:long,kind:int,end:long>>")
    rows = found.select(F.col(id_col), "row", base.alias("base")).join(new, F.col("row") == F.col("new_row"), "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return rows.select(id_col, "base", spans.alias("spans"))


def listed(spans: str) -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    texts = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    return F.array_join(texts, ",")
