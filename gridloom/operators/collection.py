"""Indexed collections as immutable tables: each change of membership or placement is a new table.

A collection has key columns, payload columns and `owner`, the rank of the element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dense(spark: SparkSession, extents: dict[str, int], mapper: Callable[[DataFrame], Column]) -> DataFrame:
    """All indices of a range. One distributed range is split into dimensions by arithmetic, the last one fastest."""
    total = 1
    for n in extents.values():
        total *= n
    out, stride = spark.range(total), total
    for name, n in extents.items():
        stride //= n
        out = out.withColumn(name, F.floor(F.col("id") / stride) % n)
    out = out.drop("id")
    return out.withColumn("owner", mapper(out))


def insert(collection: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """With new elements; one whose key is live is dropped, and of new ones with one key the least is taken."""
    fresh = new.join(collection.select(*keys), keys, "left_anti")
    first = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    return collection.unionByName(fresh.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r"))


def destroy(collection: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return collection.join(gone.select(*keys), keys, "left_anti")


def send(collection: DataFrame, messages: DataFrame, keys: list[str], drop_unknown: bool = True) -> DataFrame:
    """Messages with the elements to which they go."""
    return messages.join(collection, keys, "inner" if drop_unknown else "left")


def broadcast(collection: DataFrame, message: DataFrame) -> DataFrame:
    """One message to all elements; message has a single row."""
    return collection.crossJoin(F.broadcast(message.limit(1)))


def locate(keys: DataFrame, directory: DataFrame, on: list[str], home: Column) -> DataFrame:
    """The rank at which to look for a key: the one recorded, else its home."""
    return keys.join(directory.select(*on, "owner"), on, "left").withColumn("at", F.coalesce("owner", home)).drop("owner")


def on_rank(collection: DataFrame, rank: int) -> DataFrame:
    return collection.where(F.col("owner") == rank)


def migrate(collection: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """With owners after a plan (keys, to_rank)."""
    moved = collection.join(plan.select(*keys, "to_rank"), keys, "left")
    return moved.withColumn("owner", F.coalesce("to_rank", "owner")).drop("to_rank")


def keep_last(collection: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """The plan without the moves that would leave a rank empty: of a rank whose elements all move, the last stays."""
    marked = collection.join(plan.select(*keys, "to_rank"), keys, "left")
    of = Window.partitionBy("owner")
    last = F.row_number().over(of.orderBy(*[F.desc(k) for k in keys])) == 1
    all_go = F.count("to_rank").over(of) == F.count("*").over(of)
    return marked.withColumn("__stay", last & all_go).where("to_rank is not null and not __stay").select(*keys, "owner", "to_rank")


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Elements that a phase brings to or takes from each rank: rows (keys, owner, change)."""
    cols = [*keys, "owner"]
    arrive = after.select(*cols).exceptAll(before.select(*cols)).withColumn("change", F.lit("arrive"))
    depart = before.select(*cols).exceptAll(after.select(*cols)).withColumn("change", F.lit("depart"))
    return arrive.unionByName(depart)


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What listeners of elements hear: created, destroyed, migrated."""
    a, b = before.select(*keys, F.col("owner").alias("old")), after.select(*keys, F.col("owner").alias("new"))
    event = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "destroyed").when(F.col("old") != F.col("new"), "migrated")
    return a.join(b, keys, "full").withColumn("event", event).where("event is not null")


def group_members(ranks: DataFrame, predicate: Column) -> DataFrame:
    return ranks.where(predicate)


def multicast(objects: DataFrame, members: DataFrame) -> DataFrame:
    return objects.join(members, "rank", "left_semi")


def scatter(values: DataFrame, ranks: int | None = None) -> DataFrame:
    """Slot k of the values (columns slot, value) to rank k; without a number of ranks, there is one for every slot."""
    there = F.col("slot") >= 0
    return values.where(there if ranks is None else there & (F.col("slot") < ranks)).select(F.col("slot").alias("rank"), "value")


def tree(spark: SparkSession, ranks: int) -> DataFrame:
    """The binary spanning tree: rank, parent, children, level."""
    r = F.col("rank")
    kids = F.filter(F.array(2 * r + 1, 2 * r + 2), lambda c: c < ranks)
    level = F.floor(F.log2(r + 1) + 1e-9).cast("long")
    return spark.range(ranks).toDF("rank").select(r, F.when(r > 0, F.floor((r - 1) / 2)).alias("parent"), kids.alias("children"), level.alias("level"))


def accumulate(handle: DataFrame, updates: DataFrame, op: Callable[[Column], Column]) -> DataFrame:
    """Values of a handle (target, pos, value) after updates of the same columns by an operator."""
    return handle.unionByName(updates).groupBy("target", "pos").agg(op(F.col("value")).alias("value"))


def put(handle: DataFrame, updates: DataFrame) -> DataFrame:
    """After overwriting; updates have seq, and the last to a place stays."""
    last = updates.groupBy("target", "pos").agg(F.max_by("value", "seq").alias("new"))
    return handle.join(last, ["target", "pos"], "full").select("target", "pos", F.coalesce("new", "value").alias("value"))


def fetch_op(updates: DataFrame) -> DataFrame:
    """For sums: the value that each update (target, pos, seq, value) finds."""
    before = Window.partitionBy("target", "pos").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return updates.withColumn("found", F.coalesce(F.sum("value").over(before), F.lit(0)))


def runs(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A set of whole numbers as intervals: rows (by..., lo, hi)."""
    by = by or []
    rows = values.select(*by, F.col(value).cast("long").alias("__v")).where("__v is not null").distinct()
    island = F.col("__v") - F.row_number().over(Window.partitionBy(*by).orderBy("__v"))
    return rows.withColumn("__g", island).groupBy(*by, "__g").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).drop("__g")


def expand(intervals: DataFrame, name: str = "value") -> DataFrame:
    return intervals.select(*[c for c in intervals.columns if c not in ("lo", "hi")], F.explode(F.sequence("lo", "hi")).alias(name))


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """A ring buffer's content: the last n rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
