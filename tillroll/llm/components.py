"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a group-by (with partial aggregation) and a join; the edges are written to the
shared folder after every round.  The number of rounds grows with the logarithm of a component's
diameter and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import staged


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) -> v joined to the smallest of u and its partners, for every pair."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    return pairs.join(low, F.col("u") == F.col("c"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) with u > v."""
    return (pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root): root is the smallest node reachable; only
    nodes with an edge appear.  Self loops, repeats and either direction are fine."""
    now = staged(_ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _ordered(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _star(large)
        now = staged(_ordered(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .unionByName(small.select("u", F.col("m").alias("v")))), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
