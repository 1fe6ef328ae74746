"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest reachable node.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour,
    until all edges are stars: O(log^2 n) rounds. Minima are combined before the shuffle, so a hub
    is no hot key there; the join that hands a hub's minimum out is one that Spark can split.
    Edges of a node to itself and repeated ones are harmless; nulls are not allowed.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    size = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
    while size[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialize(small, "small-star")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        now, same, size = after, seen == size, seen
        if same:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    centres = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.unionByName(centres)
