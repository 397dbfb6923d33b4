"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch

#: Edges from which a node is a hub, at least, and hubs at most.
LEAST_HUB, HUBS = 500, 200_000


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge (src long, dst long); root is the component's smallest node.

    Large-star and small-star steps go on until the edges are stars around roots. Each round shuffles edges only, never more of them than there were, and each of its steps ends in a table in the shared folder: the driver plans one step at a time. Rounds grow
    with the logarithm of the longest chain. Hub nodes are reduced by map-side minima, and their edges meet that minimum by
    a broadcast of the hubs alone: the bound is such that there are HUBS of them at most. Self-loops and repeated edges are
    ignored; no edges give no rows.
    """
    e = scratch.save(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while not _settled(e):
        hub = max(LEAST_HUB, 2 * e.count() // HUBS)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, both.where("v > u"), hub).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.save(large)  # read four times below: in one plan it would be computed and planned as often
        small = _with_least(large, large, hub)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        after = scratch.save(small)
        scratch.drop(e)
        scratch.drop(large)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether an edge table is made of stars around roots: each node has one edge, and no root has one."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]


def _with_least(all_edges: DataFrame, edges: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with m, the least v of u in all_edges. Nodes of over hub edges are broadcast, their edges stay where they are."""
    low = all_edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(low.where(F.col("n") > hub).select("u", "m"))
    others = edges.join(hubs, "u", "left_anti").join(low.where(F.col("n") <= hub).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(others)
