"""URL filters: rules first, then trust and distrust propagated over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# absolute and protocol-relative links; a relative link stays on its host and moves no score
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""

BETWEEN_WRITES = 4  # rounds whose plan is one job


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or NULL. ``rules`` has (verdict, ``host/path``) pairs."""
    fitting = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        fitting = F.when(fits, F.lit(rule)).otherwise(fitting)
    return fitting


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``src, dst, weight`` between hosts.

    Each link to another host counts 1. A host and its nearest parent domain support each other with 1 in
    each direction where both have pages: ``blog.a.org`` and ``a.org``. Copies are added up in each task
    before the shuffle.
    """
    linked = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(LINK), 1)).alias("dst"),
    ).select("src", F.translate("dst", UPPER, LOWER).alias("dst"), F.lit(1).alias("weight"))
    hosts = pages.select(host_of(F.col(url_col)).alias("src")).filter("src <> ''").distinct()
    labels = F.split("src", r"\.")
    parents = F.transform(
        F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    above = hosts.filter(F.size(labels) > 1).select("src", F.posexplode(parents).alias("_depth", "dst"))
    known = above.join(hosts.select(F.col("src").alias("_host")), F.col("dst") == F.col("_host"), "left_semi")
    nearest = known.groupBy("src").agg(F.min_by("dst", "_depth").alias("dst")).withColumn("weight", F.lit(1))
    back = nearest.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    edges = linked.unionByName(nearest).unionByName(back).filter("src <> dst AND src <> '' AND dst <> ''")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.001, rounds: int | None = None
) -> DataFrame:
    """Personalised PageRank of both kinds: ``host, trust, distrust`` from ``host, allowed, blocked`` counts.

    Trust starts at the allowed pages and follows the edges; distrust starts at the blocked pages and follows
    them backwards, from a blocked host to those that link to it. Each kind's seeds add up to 1. What a host
    without edges would pass on is dropped, so scores add up to at most 1. Hosts that neither score reaches
    are left out. Each round shuffles one row per edge and kind; a hub's sum is made in each task first.

    What a host got in a round (``moving``) is passed on in the next one and stays in its score (``score``), so the
    share still on its way shrinks by ``damping`` in every round, wherever the links lead. The rounds end when it
    is at most ``tolerance`` for each kind, that is after 43 rounds at most by default and earlier where
    chains of links end; each host's score is then within twice that of the settled one. ``rounds`` asks for that
    many instead.
    """
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError("damping must be at least 0 and below 1, and tolerance above 0")
    starts = seeds.agg(F.sum("allowed").alias("_a"), F.sum("blocked").alias("_b")).first()
    total = {"trust": float(starts["_a"] or 0), "distrust": float(starts["_b"] or 0)}
    start = seeds.select("host", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), (F.col(col) / F.lit(total[kind] or 1.0)).alias("seed"))
        for kind, col in (("trust", "allowed"), ("distrust", "blocked"))
    ])).alias("s")).select("host", "s.kind", "s.seed").filter("seed > 0")
    start = stored(start, "trust-seeds")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")
    ))
    degrees = both.groupBy("kind", "src").agg(F.sum("weight").alias("_out"))
    steps = stored(both.join(degrees, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("_out") * damping).alias("part")
    ), "trust-steps")
    state = start.select("kind", "host", F.lit(0.0).alias("score"), (F.col("seed") * (1 - damping)).alias("moving"))
    done, settled = 0, rounds == 0
    while not settled:
        batch = BETWEEN_WRITES if rounds is None else min(BETWEEN_WRITES, rounds - done)
        for _ in range(batch):
            moved = state.filter("moving > 0").join(steps, ["kind", "host"]).select(
                "kind", F.col("dst").alias("host"), F.lit(0.0).alias("score"),
                (F.col("moving") * F.col("part")).alias("moving"),
            )
            kept = state.select("kind", "host", (F.col("score") + F.col("moving")).alias("score"), F.lit(0.0).alias("moving"))
            state = moved.unionByName(kept).groupBy("kind", "host").agg(
                F.sum("score").alias("score"), F.sum("moving").alias("moving")
            )
        state, done = stored(state, "trust-scores"), done + batch
        if rounds is None:
            left = state.groupBy("kind").agg(F.sum("moving").alias("left")).agg(F.max("left")).first()[0]
            settled = (left or 0.0) <= tolerance * (1 - damping)
        else:
            settled = done == rounds
    # what is still on its way is counted where it has got to, with all that would follow
    scores = state.select("kind", "host", (F.col("score") + F.col("moving") / (1 - damping)).alias("score"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = 1.0,
    floor: float = 0.1,
    tolerance: float = 0.001,
) -> DataFrame:
    """Adds ``host, path, rule, verdict, trust, distrust`` to each page; columns of those names are replaced.

    A page that a rule fits gets the rule's verdict. The others get their host's: the pages that rules decide
    are the seeds, and a host is blocked if its distrust is above ``ratio`` times its trust and above ``floor``
    times the mean distrust of a host with pages. Without such evidence it is allowed. A NULL url, or one
    without ``://``, has an empty host and path, fits no rule and is allowed. NULL html has no links. Repeated
    pages count as often as they appear. An empty table gives an empty frame.
    """
    results = ["host", "path", "rule", "verdict", "trust", "distrust"]
    pages = pages.drop(*[c for c in results if c not in (url_col, html_col)])
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    told = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    told = told.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    given = F.lit(None).cast("string") if not rules else F.element_at(
        F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair]), F.col("rule")
    )
    told = told.withColumn("_given", given)
    counts = told.filter("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("_given") == "allow", 1).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("_given") == "block", 1).otherwise(0)).alias("blocked"),
    )
    counts = stored(counts, "trust-hosts")
    scores = propagate(host_links(pages, url_col, html_col), counts, tolerance=tolerance)
    mean = counts.agg((F.lit(1.0) / F.greatest(F.count("*"), F.lit(1))).alias("_mean"))
    scores = scores.select(
        F.col("host").alias("_host"), "trust", "distrust",
        ((F.col("distrust") > F.lit(ratio) * F.col("trust"))
         & (F.col("distrust") > F.lit(floor) * mean.scalar())).alias("_blocked"),
    )
    judged = told.drop(html_col).join(scores, F.col("host") == F.col("_host"), "left")
    own = F.when(F.coalesce("_blocked", F.lit(False)), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("_given", own)).withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")
    }).drop("_host", "_given", "_blocked")
