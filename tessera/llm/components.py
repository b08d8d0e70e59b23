"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; stars shrink to depth one in a logarithmic number of rounds, and a node of
any degree is spread over tasks by the join's skew handling. Edges never leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import drop, materialize

#: Keys that a join takes out of the shuffle, at most.
HOT_KEYS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with the one row (key, n, ...) that the table ``groups`` has of some keys, n being the rows of that key.

    Keys with more than ``total / HOT_KEYS`` rows can't be more than ``HOT_KEYS``: these groups are broadcast and their rows
    stay where they are. All others are joined by a shuffle, in which no key has more than that share.
    """
    least = max(256, total // HOT_KEYS + 1)
    hot = [r[0] for r in groups.where(F.col("n") >= least).select(key).collect()]
    groups = groups.drop("n")
    if not hot:
        return rows.join(groups, key)
    is_hot = F.col(key).isin(hot)
    spread = rows.where(is_hot).join(F.broadcast(groups.where(is_hot)), key)
    return spread.unionByName(rows.where(~is_hot).join(groups.where(~is_hot), key))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether all edges (u > v) are stars: no node has two lower ones, and none of the lower ones has a lower one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count() == 0


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): each node that has an edge to another, and the smallest node that it reaches.

    Edges may be given in either direction, repeated, with nulls (ignored) or from a node to itself (ignored).
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "components")
    for _ in range(max_rounds):
        if _settled(e):
            break
        last, e = e, materialize(_small_star(_large_star(e)), "components")
        drop(last)
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
