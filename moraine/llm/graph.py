"""Connected components over an edge table, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). The number of
rounds grows with the logarithm of the longest path; every round keeps at most as many
edges as it was given. Rounds are staged as Parquet in the shared folder, so neither links
nor labels ever reach the driver and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import staged, unstaged

#: Rounds before giving up; log2 of the path length is needed, so this is never met.
MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, root): root is the smallest node reachable; nodes without edges are absent.

    Self-loops and rows with a null end are ignored; repeated pairs count once. An empty table
    gives an empty table.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = staged(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _signature(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are staged so that the join below has a shuffle on either side, which adaptive execution can split for a hub.
        lower = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = staged(both.where("v > u").join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(now)
        unstaged(old, lower, large, least)  # the round's result is written; nothing goes back to what it was made from
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    # At the fixed point every edge goes from a node to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
