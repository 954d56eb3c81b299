"""Load and communication statistics of phases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.comm import COLLECTIVE, off_rank


def moments(df: DataFrame, value: str, by: Iterable[str] = ()) -> DataFrame:
    """max, sum, min, avg, var, std, skw, kur, I, npr, car of a value for each group, from mergeable moments."""
    x, n = F.col(value).cast("double"), F.count("*").cast("double")
    m2 = F.var_pop(x) * n
    flat = (n <= 1) | (m2 <= 1e-300)
    skw = F.when(flat, 0.0).otherwise(F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))
    kur = F.when(flat, 0.0).otherwise((F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2)) - 3)
    avg = F.avg(x)
    return df.groupBy(*by).agg(
        F.max(x).alias("max"), F.sum(x).alias("sum"), F.min(x).alias("min"), avg.alias("avg"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("std"),
        skw.alias("skw"), kur.alias("kur"), imbalance(F.max(x), avg).alias("I"),
        F.count_if(x != 0).alias("npr"), F.count("*").alias("car"),
    )


def imbalance(top: Column, avg: Column) -> Column:
    """How far the largest exceeds the mean; 0 without load."""
    return F.when(avg > 0, top / avg - 1).otherwise(0.0)


def rank_loads(loads: DataFrame, ranks: int, rank: str = "rank", load: str = "load", by: Iterable[str] = ("phase",)) -> DataFrame:
    """The load of every rank in every group; a rank without objects has 0."""
    by = list(by)
    spark: SparkSession = loads.sparkSession
    summed = loads.groupBy(*by, rank).agg(F.sum(load).alias(load))
    spine = loads.select(*by).distinct().crossJoin(F.broadcast(spark.range(ranks).withColumnRenamed("id", rank)))
    return spine.join(summed, [*by, rank], "left").withColumn(load, F.coalesce(load, F.lit(0)))


def stack(df: DataFrame, by: list[str], quantities: dict[str, str]) -> DataFrame:
    """Rows (by..., statistic, value): named columns one below the other, for one grouped pass over all."""
    pairs = F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(c).cast("double").alias("value")) for k, c in quantities.items()))
    return df.select(*by, F.explode(pairs).alias("q")).select(*by, "q.statistic", "q.value")


#: Kinds of load and their columns; a table of objects has those that are known of it.
LOADS = {"load": "load", "load_modelled": "modelled", "strategy_load_modelled": "strategy"}


def statistics(objects: DataFrame, edges: DataFrame | None, ranks: int) -> DataFrame:
    """All statistics (see moments) of object and rank loads and communication, by phase: Object_ and Rank_ of comm and of
    each kind of load in LOADS that objects has. Without edges, of loads only.

    objects: phase, object, rank, load (as recorded), and if known modelled (what a model expects) and strategy (what the
    rebalancing strategy's own model does). edges: phase, category, from_object, to_object, from_rank, to_rank, bytes."""
    kinds = {name: c for name, c in LOADS.items() if c in objects.columns}
    loads = objects.groupBy("phase", "rank").agg(*(F.sum(c).alias(c) for c in kinds.values()))
    spine = objects.select("phase").distinct().join(F.broadcast(objects.sparkSession.range(ranks).withColumnRenamed("id", "rank")))
    by_object, by_rank = objects.select("phase", "object", *kinds.values()), spine.join(loads, ["phase", "rank"], "left")
    quantities = dict(kinds)
    if edges is not None:
        quantities["comm"] = "comm"
        sent = edges.where((F.col("category") == "SendRecv") & (F.col("from_object") != F.col("to_object")))
        comm = sent.groupBy("phase", F.col("from_object").alias("object")).agg(F.sum("bytes").alias("comm"))
        by_object = by_object.join(comm, ["phase", "object"], "left").withColumn("comm", F.coalesce("comm", F.lit(0)))
        away = edges.where(off_rank(F.col("from_rank"), F.col("to_rank")) & (F.col("from_object") != F.col("to_object")) & ~F.col("category").isin(*COLLECTIVE))
        rank_comm = away.groupBy("phase", F.col("from_rank").alias("rank")).agg(F.sum("bytes").alias("comm"))
        by_rank = by_rank.join(rank_comm, ["phase", "rank"], "left")
    by_rank = by_rank.na.fill(0, [*quantities.values()])
    rows = stack(by_object, ["phase"], {f"Object_{k}": c for k, c in quantities.items()}).unionByName(
        stack(by_rank, ["phase"], {f"Rank_{k}": c for k, c in quantities.items()})
    )
    return moments(rows, "value", ["phase", "statistic"])


def sample_bins(load_seconds: Column, width: int = 10) -> Column:
    """The bin of a load: the upper end, in milliseconds, of its interval of the width."""
    return (F.floor(F.floor(load_seconds * 1000) / width) * width + width).cast("long")


def element_loads(events: DataFrame, by: Iterable[str] = ("phase", "object")) -> DataFrame:
    """Recorded handler times (begin, end) to loads."""
    return events.groupBy(*by).agg(F.sum(F.col("end") - F.col("begin")).alias("load"))


def element_comm(messages: DataFrame, by: Iterable[str] = ("phase", "from_object", "to_object")) -> DataFrame:
    return messages.groupBy(*by).agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))


def once_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key on several rows fails the query, as an element reports once a phase."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("an element reported twice")).cast("boolean"))).drop("__n")


def diagnostics(values: DataFrame, by: Iterable[str] = ("component", "metric")) -> DataFrame:
    """Totals of metric values (one row a rank; null where a rank has not updated it)."""
    v = F.col("value")
    return values.groupBy(*by).agg(
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.count(v).alias("ranks")
    )


#: How updates of a diagnostic value combine.
UPDATE_MODES = {
    "sum": lambda v, ts: F.sum(v), "avg": lambda v, ts: F.avg(v), "replace": lambda v, ts: F.max_by(v, ts),
    "min": lambda v, ts: F.min(v), "max": lambda v, ts: F.max(v),
}


def meter(values: DataFrame, kind: str, by: Iterable[str]) -> DataFrame:
    """The derived metrics of a counter, gauge, timer (begin, end) or counter with gauge (n, value)."""
    v = F.col("end") - F.col("begin") if kind == "timer" else F.col("value")
    found = {"sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v)}
    if kind == "counter":
        found = {"sum": F.sum(v)}
    if kind == "counter_gauge":
        found |= {"count": F.sum("n")}
    return values.groupBy(*by).agg(*(c.alias(k) for k, c in found.items()))


def advice(top: Column, avg: Column, largest: Column) -> Column:
    """What is to be gained by rebalancing a phase, from the largest and the mean rank load and the largest object: its
    gain is the share by which the mean is below the largest, in percent, and an object larger than the mean limits it."""
    gain, grain = (top - avg) / top * 100, (top - largest) / top * 100
    return (
        F.when((top <= 0) | (gain <= 3.0), "nothing to gain").when(grain < 0.5, "an object blocks the gain")
        .when(grain >= gain - 1.0, "rebalance").otherwise("rebalance, limited by an object")
    )


def advice_after(top: Column, top_after: Column, avg_after: Column, largest: Column) -> Column:
    """The same of a phase that was rebalanced: whether it helped, and whether an object blocks what is left to gain."""
    helped = F.when(top / top_after >= 1.005, "faster").otherwise("hardly faster")
    blocked = ((top_after - avg_after) / top_after * 100 > 3.0) & ((top_after - largest) / top_after * 100 < 0.5)
    return F.when(blocked, F.concat(helped, F.lit(", an object blocks the rest"))).otherwise(helped)
