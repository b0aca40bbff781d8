"""Connected components of links, on the cluster, with hot nodes spread.

Rounds of two steps until nothing changes: each node's larger neighbours are
linked to its smallest one, then each node and its smaller neighbours to the
smallest of them. Both steps are aggregates that combine before the shuffle and
joins whose hot keys adaptive execution splits. Rounds grow with the logarithm
of the longest chain. Neither links nor labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import checkpointed


def _digest(edges: DataFrame) -> tuple:
    """Number and two 64-bit sums of the rows: one small aggregate instead of joins of the old and new edges both ways."""
    sums = [F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes with a link; `links` has columns a, b. The component is its smallest node."""
    edges = checkpointed(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = _digest(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(spark, large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = checkpointed(spark, small.select("e.u", "e.v").where("u <> v").distinct())
        # Done when every node has one smaller neighbour, and that one none: then a round changes nothing.
        edges, before, known = new, known, _digest(new)
        if known == before:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))
