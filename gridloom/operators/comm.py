"""Communication edges: predicates, symmetry, volumes, and the work that they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The categories of edges.
CATEGORIES = (
    "SendRecv", "CollectionToNode", "NodeToCollection", "Broadcast", "CollectionToNodeBcast", "NodeToCollectionBcast",
    "CollectiveToCollectionBcast", "LocalInvoke", "WriteShared", "ReadOnlyShared",
)
COLLECTIVE = ("Broadcast", "CollectionToNodeBcast", "NodeToCollectionBcast")


def off_rank(from_rank: Column, to_rank: Column, category: Column | None = None) -> Column:
    """Whether an edge leaves its rank; edges that are not between objects always do."""
    away = from_rank != to_rank
    return away if category is None else F.when(category == "SendRecv", away).otherwise(F.lit(True))


def self_edge(from_object: Column, to_object: Column) -> Column:
    return from_object == to_object


def collective(category: Column) -> Column:
    return category.isin(*COLLECTIVE)


def volume(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("messages").alias("messages"))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges of both directions as one, named by the greater and the lesser object."""
    pair = (F.greatest("from_object", "to_object").alias("hi"), F.least("from_object", "to_object").alias("lo"))
    return edges.where("from_object != to_object").groupBy(*pair).agg(F.sum("bytes").alias("bytes"), F.sum("messages").alias("messages"))


def placed(edges: DataFrame, placement: DataFrame) -> DataFrame:
    """Edges with the ranks of their ends. placement: object, rank."""
    a = placement.select(F.col("object").alias("from_object"), F.col("rank").alias("from_rank"))
    b = placement.select(F.col("object").alias("to_object"), F.col("rank").alias("to_rank"))
    return edges.join(a, "from_object").join(b, "to_object")


def symmetrised(edges: DataFrame, once: bool = False) -> DataFrame:
    """Every rank's edges: those it recorded, and for off-rank SendRecv edges those that the other end's rank recorded.
    An edge that a rank already has is kept once; with once, edges have each category and pair of objects on one row."""
    far = (F.col("category") == "SendRecv") & (F.col("from_rank") != F.col("to_rank"))
    ranks = F.when(far, F.array("from_rank", "to_rank")).otherwise(F.array("from_rank"))
    every = edges.withColumn("rank", F.explode(ranks))
    return every if once else every.dropDuplicates(["rank", "category", "from_object", "to_object"])


def rank_volumes(placed_edges: DataFrame) -> DataFrame:
    """Bytes between objects that each rank keeps, sends and receives."""
    e = placed_edges.where("from_object != to_object")
    inside = F.col("from_rank") == F.col("to_rank")
    out = e.groupBy(F.col("from_rank").alias("rank")).agg(F.sum(F.when(inside, F.col("bytes")).otherwise(0)).alias("intra"), F.sum(F.when(inside, 0).otherwise(F.col("bytes"))).alias("sent"))
    inn = e.where(~inside).groupBy(F.col("to_rank").alias("rank")).agg(F.sum("bytes").alias("received"))
    return out.join(inn, "rank", "full").na.fill(0)


def work(load: Column, inter: Column, intra: Column, shared: Column, alpha: float, beta: float, gamma: float, delta: float) -> Column:
    return alpha * load + beta * inter + gamma * intra + delta * shared
