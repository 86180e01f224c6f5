"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _toward_minimum(directed: DataFrame) -> DataFrame:
    """Each (u, v) becomes (v, least of u and u's neighbours); a hub's rows are split by the skew join."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round is two joins on hashed node ids, checkpointed; it ends when the edge set is a star
    forest. Nulls and self loops are ignored, so a node without another neighbour has no row; an
    empty input gives no rows. Raises if ``rounds`` do not suffice (their number grows with the
    logarithm of the longest path).
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u > v").distinct()
        small = _toward_minimum(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        now = materialize(small.where("a <> b").distinct())
        after = _signature(now)
        if after == before:
            node = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return node.union(now.select("b", "b").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
