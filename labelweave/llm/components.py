"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins, so a node with a third of all edges is pre-aggregated
before it is shuffled and its join partition can be split by Spark. Rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Loops, repeated edges, edges in both directions and edges with a null end are allowed; the last are
    ignored. No edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = scratch.save(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(keep=1)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
