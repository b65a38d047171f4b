"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, with_range


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u > v): every node moves towards smaller ones.

    The rows of one node, which may be the centre of a third of all edges, are dealt into parts by their other end.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = with_range(both, "u", "v", "v").filter("v > u").select(F.col("v").alias("u"), F.least("u", "low_v").alias("v")).filter("u > v").distinct()
    small = with_range(large, "u", "v", "v")
    moved = small.select(F.col("v").alias("u"), F.col("low_v").alias("v")).unionByName(small.select("u", F.col("low_v").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, limit: int = 64) -> DataFrame:
    """Nodes and the smallest node that they reach: node, root. links has the columns u and v of one type.

    Nulls and self-links are left out; a node with no other link is not in the result. A node of any degree is
    only ever aggregated or joined by hash, never gathered in one task. Each round is written to the scratch
    folder, and the rounds end when every node hangs on its root: no node is both a child and a parent.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    for _ in range(limit):
        split = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if split.unionByName(chained).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        moved = materialize(_stars(edges), "links")
        discard(edges)
        edges = moved
    raise RuntimeError(f"components did not settle in {limit} rounds")
