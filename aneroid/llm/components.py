"""Connected components of a graph given as edges, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aneroid.scratch import stored


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, component`` for every node of ``a, b``; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one (large star), then all its smaller
    neighbours and itself to the smallest (small star), and ends when the edges no longer change: a number of
    rounds that grows with the logarithm of the graph. The edges are written after each round. A node with a
    third of all edges has its minimum found in each task first, and its edges are joined, not collected.
    """
    edges = stored(_ordered(edges), "components")
    before = _mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        # of an edge the larger end is a: its smaller neighbours are b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = stored(_ordered(small), "components")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
