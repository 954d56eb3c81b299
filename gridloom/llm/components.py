"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Columns u, v (longs) of undirected edges to rows (node, label): label is the component's smallest node.

    Nodes without an edge are absent, as are null ends and loops. Each round is two aggregations and joins; a star's
    centre is never gathered in one task, as minima are combined before the shuffle. The number of rounds grows with
    the logarithm of the number of nodes. An empty table gives an empty one."""
    edges = scratch.keep(
        edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    before = _mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        # large-star: every larger neighbour of a node is linked with the least of its neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("m").alias("u"), "v").distinct()
        # small-star: a node's smaller neighbours, and itself, are linked with the least of them
        down = large.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
        lows = down.groupBy("x").agg(F.min("y").alias("m"))
        linked = down.join(lows, "x")
        small = (
            linked.where("y != m").select(F.col("m").alias("u"), F.col("y").alias("v"))
            .unionByName(lows.select(F.col("m").alias("u"), F.col("x").alias("v")))
            .distinct()
        )
        after = scratch.keep(small)
        mark = _mark(after)
        scratch.drop(edges)
        edges = after
        if mark == before:
            break
        before = mark
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    )
