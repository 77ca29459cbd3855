"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.llm.numbering import hash_bucket, running

# region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def regular_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """A tree of ``shards`` shards of weight 1, filled rack by rack and region by region."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own.

    No other subtree's weight changes, so rows can only move into the new shard.
    """
    name = f"region{len(tree)}"
    if name in tree or any(shard in leaves for racks in tree.values() for leaves in racks.values()):
        raise ValueError(f"{name} or shard {shard} is there already")
    return {**tree, name: {"rack0": {shard: weight}}}


def _draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw with rate ``weight`` that depends on the key and the child's path alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(weight))


def _descend(key: Column, node: dict, path: str) -> Column:
    """The leaf under ``node``: at each level the child with the least draw wins."""
    if not node:
        raise ValueError(f"no child under {path!r}")
    children = list(node.items())
    weights = [_weight(child) for _, child in children]
    if min(weights) <= 0:
        raise ValueError(f"a weight under {path!r} is not positive")
    below = [
        _descend(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(int(name))
        for name, child in children
    ]
    if len(children) == 1:
        return below[0]
    draws = [
        F.struct(_draw(key, f"{path}/{name}", w).alias("draw"), F.lit(i).alias("child"))
        for i, ((name, _), w) in enumerate(zip(children, weights, strict=True))
    ]
    winner = F.array_min(F.array(*draws))["child"]
    return F.get(F.array(*below), winner) if all(not isinstance(c, dict) for _, c in children) else reduce(
        lambda rest, i: F.when(winner == i, below[i]).otherwise(rest), range(len(below) - 1), below[-1]
    )


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: a pure expression over the key and the tree.

    The weight of a subtree is the sum of its shards' weights. A draw depends on the key and the child's own
    path and weight. When one child's weight grows, rows move into that child only; when it shrinks, only out
    of it. Below a node whose children keep their weights nothing moves. A NULL key counts as the text "null".
    """
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), tree, "")


def shard(
    df: DataFrame, key: str, tree: Tree, shard_col: str = "shard", slot_col: str | None = "slot", buckets: int = 1024
) -> DataFrame:
    """Adds the row's shard and its slot there: 0, 1, ... without gaps, in the order of (hashed bucket, key).

    Shards are counted per (shard, bucket) and rows are ranked inside a bucket, so no task sees a whole shard.
    Rows with one key share a shard; fully equal rows get neighbouring slots in any order. An empty table
    gives an empty frame. Columns already named like the results are replaced.
    """
    df = df.drop(shard_col, *([slot_col] if slot_col else [])).withColumn(shard_col, shard_of(F.col(key), tree))
    if slot_col is None:
        return df
    df = df.withColumn("_slot_bucket", hash_bucket(key, buckets=buckets))
    rest = [F.col(c) for c in df.columns if c not in (key, "_slot_bucket", shard_col) and _orderable(df, c)]
    return running(df, shard_col, "_slot_bucket", [F.col(key), *rest], F.lit(1), slot_col).drop("_slot_bucket")


def _orderable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.simpleString().startswith(("map", "array<map", "variant"))
