"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import shared_checkpoint


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map each node of edges(a, b) to the smallest node that it reaches: columns node, component.

    Each round attaches larger neighbours to a node's smallest neighbour (large star) and then smaller ones
    to it (small star); the edges become stars around the smallest node of each component in a logarithmic
    number of rounds. A node's neighbours are never gathered: each step is a minimum by node, combined before the
    shuffle, and a join whose large partitions adaptive execution splits. Rounds end at a reliable checkpoint.
    Nodes without an edge and self-loops do not appear. Nulls are dropped.
    """
    kind = edges.schema["a"].dataType
    edges = edges.where("a is not null and b is not null and a != b")
    now = shared_checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        now = shared_checkpoint(small)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).select(
        F.col("node").cast(kind), F.col("component").cast(kind)
    )
