"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.shared import written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest neighbour of u; it is pre-aggregated, so no hub meets in one task."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (columns a, b); the label is the component's smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones too; a chain
    halves per round. It is done when every node that hangs does so once, on a node that hangs nowhere. Only
    the links are kept, each round is a written table."""
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where("a <> b").select(larger.alias("u"), smaller.alias("v"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        hung = _with_least(large)
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).union(edges.select("v", F.lit(0)).distinct())
        per_node = ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.count(F.lit(1)).alias("roles"))
        if per_node.where("n > 1 OR (n = 1 AND roles > 1)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def nearby(links: DataFrame) -> DataFrame:
    """(node, label): nodes with one label are connected, though not all connected nodes have one. For links
    (a, b) that are stars around few hubs a this is nearly the components, without a loop."""
    first = links.groupBy("b").agg(F.min("a").alias("l"))
    hubs = links.join(first, "b").groupBy("a").agg(F.least(F.min("l"), F.col("a")).alias("l"))
    leaves = links.join(hubs, "a").groupBy("b").agg(F.min("l").alias("l"))
    every = leaves.select(F.col("b").alias("node"), "l").union(hubs.select("a", "l"))
    return every.groupBy("node").agg(F.min("l").alias("label"))
