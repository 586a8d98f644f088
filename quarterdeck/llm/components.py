"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import save_stage


def _stars(edges: DataFrame, below: bool) -> DataFrame:
    """Hang the larger (or the smaller, and itself) neighbours of every node onto its smallest one.

    Only minima are aggregated; no neighbour list is ever collected.
    """
    if below:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        hung = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of ``edges`` (columns a, b)."""
    current = save_stage(edges.filter("a <> b").select("a", "b"), "components")
    before = None
    while True:
        current = save_stage(_stars(_stars(current, False), True), "components")
        # settled when the edges no longer change: their number and an order-free fingerprint
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
        before = now
