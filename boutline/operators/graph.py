"""Graphs of a table of edges: labels that spread hop by hop, connected components.

Each hop is a join and an aggregation; what a hop adds is written as a checkpoint, so that lineage stays short and lost executors cost one hop.
Only a count comes to the driver. Null ends and self-loops are left out; empty tables give the seeds, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.durable import checkpointed


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def spread_labels(seeds: DataFrame, edges: DataFrame, node: str = "node", label: str = "label", a: str = "a", b: str = "b") -> DataFrame:
    """node, label, hops: each node takes the label of its nearest seeds (J25). A node that different labels reach in the same hop stays unknown and passes
    nothing on, and so does what lies only behind it. Of several labels of one seed, the smallest counts."""
    links = checkpointed(both_ways(edges, a, b))
    front = seeds.where(F.col(node).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(label).alias("label")).withColumn("hops", F.lit(0))
    front = seen = checkpointed(front)
    hops = 0
    while True:
        hops += 1
        reached = front.where("label IS NOT NULL").join(links, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
        fresh = reached.join(seen.select("node"), "node", "left_anti")
        front = checkpointed(fresh.select("node", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"), F.lit(hops).alias("hops")))
        if front.isEmpty():
            return seen.where("label IS NOT NULL").select(F.col("node").alias(node), F.col("label").alias(label), "hops")
        seen = seen.unionByName(front)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable. Nodes point to a smaller neighbour, then to what that one points to, so the number of rounds grows
    with the logarithm of a path's length."""
    links = checkpointed(both_ways(edges, a, b))
    roots = checkpointed(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        at = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        lifted = roots.join(at, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"))
        # The lowest root a neighbour has, for the node and for the root it has itself.
        seen = links.join(lifted.withColumnRenamed("node", "_m"), F.col("b") == F.col("_m")).select(F.col("a").alias("node"), "root")
        low = lifted.unionByName(seen).groupBy("node").agg(F.min("root").alias("low"))
        hooked = low.join(lifted, "node").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("low"))
        new = checkpointed(low.unionByName(hooked).groupBy("node").agg(F.min("low").alias("root")))
        if new.join(roots.withColumnRenamed("root", "_r"), "node").where("root != _r").isEmpty():
            return new.select("node", F.col("root").alias("component"))
        roots = new
