"""Connected components by alternating large and small stars (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import keep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours move to the least neighbour. Small star: the node and its
    smaller neighbours do. A node's least neighbour is found by a map-side minimum and joined
    back, so a hub's edges are never gathered in one task."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
    if large:
        both = both.unionAll(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    moved = linked.filter(F.col("v") > F.col("u")) if large else linked.filter(F.col("v") != F.col("m"))
    out = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b) with a < b: the least node that links
    reach. Each round is written to the shared folder; rounds grow with the logarithm of the
    longest chain."""
    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = keep(edges.select("a", "b").filter("a < b").distinct(), "edges")
    now = state(edges)
    while True:
        edges = keep(_stars(_stars(edges, large=True), large=False), "edges")
        after = state(edges)
        if after == now:
            break
        now = after
    # Every node but the components' least ones has one edge to its component now.
    return (edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
