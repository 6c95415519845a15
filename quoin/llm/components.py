"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step is a minimum per node (combined on the map side) and a join back to
the edges, so that a hub's edges never meet in one task; the least
nodes are checkpointed before the join, which so deals both sides out anew and can split a
hub between tasks. The edges are checkpointed after each round. Components end as stars around their least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._base import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (u, v long, any direction).

    Loops and repeated edges do no harm; no edge gives no row. Rounds grow with the logarithm
    of the longest path; if ``rounds`` do not suffice, that is an error and not a result.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = checkpointed(now), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = checkpointed(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
