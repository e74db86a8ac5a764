"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import written


def _stars(edges: DataFrame, *, larger: bool) -> DataFrame:
    """One step: each node's neighbours (all larger ones, or the node and all smaller ones) go to its smallest."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    met = both.join(least, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; the component is its smallest node.

    Alternates two star steps until nothing changes: the number of rounds grows with the
    logarithm of the longest path, and each round is two aggregates and two joins, written down.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, purpose), None
    while True:
        rows = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if rows == before or not rows[0]:
            break
        before = rows
        edges = written(_stars(_stars(edges, larger=True), larger=False), purpose)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
