"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge between two different nodes.

    Each round is two aggregations with partial minima and two joins on the node, whose larger side Spark may split
    where a node has many neighbours. Rounds are cut by checkpoints in the shared folder. Edges never
    multiply: a round keeps at most one edge for each edge that it reads.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialized(now)
    state = _state(now)
    for _ in range(max_rounds):
        now = materialized(_small_star(_large_star(now)))
        then, state = state, _state(now)
        if then == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components have not settled")


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).head()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u").where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
