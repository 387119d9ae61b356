"""Connected components by alternating large-star and small-star steps.

Both steps are joins and partial aggregations on edge rows; a node of any
degree is aggregated before the shuffle and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored_with


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of an edge; the component is its smallest node.

    ``edges`` has two long columns ``u`` and ``v``.  Loops, null ends and
    repeated edges are allowed and change nothing; nodes without an edge to
    another node are not returned.  Raises if it has not settled after
    ``max_rounds`` rounds (the rounds grow with the logarithm of the size).
    """
    state = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
    plain = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, before = stored_with(plain.distinct(), "edges", *state)
    if before["n"] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        last = now
        now, after = stored_with(_small_star(_large_star(last)), "edges", *state)
        discard(last)
        if after == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
        before = after
    raise RuntimeError("components did not settle")
