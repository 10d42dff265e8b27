"""Connected components of an edge table, on Spark, by alternating large-star and small-star steps.

Each step takes minima with partial aggregation, so a hub with a third of all edges costs one row per task,
and joins two written tables, so Spark can split the hub's partition.  A pass inside each partition first
replaces the edges by a spanning forest.  Every round ends in a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.scratch import Scratch

EDGE = "src long, dst long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b, and for each the smallest node reachable by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _forest(batches):
    """Star edges (node, smallest node of its part) of the edges of one partition, a bounded chunk at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= 2_000_000:
            yield _stars(held)
            held, size = [], 0
    if size:
        yield _stars(held)


def _stars(held: list[pd.DataFrame]) -> pd.DataFrame:
    e = pd.concat(held)
    nodes, root = local_roots(e["src"].to_numpy(), e["dst"].to_numpy())
    moved = nodes != root
    return pd.DataFrame({"src": nodes[moved], "dst": root[moved]})


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min("dst").alias("low"))


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for each node of `edges` (src, dst: long), component the smallest node reachable.

    Self loops, repeated edges and either direction are fine; rows with a null end are ignored; no edges give
    no rows.  Nodes without an edge to another node aren't returned.
    """
    scratch = scratch or Scratch(spark, "components")
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    now = scratch.table(clean.mapInPandas(_forest, EDGE).distinct(), "forest")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lows = scratch.table(_minima(both).select("src", F.least("src", "low").alias("low")), "lows")
        large = scratch.table(both.join(lows, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct(), "large")
        scratch.drop(lows, now)
        lows = scratch.table(_minima(large), "lows")
        hung = large.join(lows, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        now = scratch.table(hung.unionByName(lows.select("src", F.col("low").alias("dst"))).distinct(), "small")
        scratch.drop(lows, large)
    roots = now.groupBy(F.col("dst").alias("node")).agg(F.first("dst").alias("component"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")
    return bad.agg(F.count("*").alias("n")).first()["n"] == 0
