"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.llm import shared


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, with their number and the sum of their hashes."""
    seen = Observation()
    figures = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    kept = shared.table(edges.observe(seen, *figures), name)
    return kept, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``.

    ``component`` is the least node that is reachable. Alternating large and
    small stars (Kiveris et al., 2014) reach stars in a number of rounds that
    grows with the logarithm of the longest path. Each round's edges are
    written to the shared folder, and no more than a count reaches the driver.
    Nulls take no part; an empty table gives an empty table.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = _kept(edges, name)
    while before[0]:
        # Large star: every larger neighbour of a node joins the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour of a node, and the node, join the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old = edges
        edges, after = _kept(small, name)
        shared.drop(old)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
