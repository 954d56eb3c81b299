"""Queries that write files or run streams and give back what was written: checkpoints, appended and compressed files,
callbacks, and streams of the events table."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import auto_threshold
from gridloom.operators import rebalance as rb, reduce as rd, stats
from gridloom.plans.registry import query
from gridloom.plans.tables import PLACED, PLACEMENT, RANK_LOADS, RANKS, placed, placement, table
from gridloom.session import shared_dir
from gridloom.sources import lbdata
from gridloom.streaming import phases


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type FROM events")
def s07_json_appender(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts appended one after the other."""
    path, events = _folder(spark, "appended"), table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in range(4):
        lbdata.append(events.where(F.pmod("event_id", F.lit(4)) == part), path)
    return spark.read.schema(events.schema).json(path)


@query(f"WITH {PLACED} SELECT phase, rank, object, round(load / 100.0, 2) AS load FROM placed")
def s08_x06_compressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load data files as generated, compressed and read back."""
    path = _folder(spark, "load-data")
    rows = placed(spark, sf_dir).select("phase", "rank", "object", F.lit(True).alias("migratable"), (F.col("load") / 100.0).alias("load"), F.array().cast("array<double>").alias("subs"))
    lbdata.write(rows, path, compression="gzip")
    return lbdata.tasks(lbdata.read(spark, path)).select("phase", "rank", "object", F.round("load", 2).alias("load"))


@query(f"WITH {PLACEMENT} SELECT object, rank AS owner, object * 10 AS state FROM placement")
def s18_s19_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "collection")
    lbdata.checkpoint(placement(spark, sf_dir).select("object", F.col("rank").alias("owner"), (F.col("object") * 10).alias("state")), path, ["object"])
    return lbdata.restore(spark, path, ["object"]).select("object", "owner", "state")


@query("SELECT max(o_totalprice) AS largest FROM orders")
def a17_reduce_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard: list = []
    rd.reduce_with_callback(table(spark, sf_dir, "orders"), "max", "o_totalprice", heard.append)
    return spark.createDataFrame([(heard[0],)], "largest double")


@query("SELECT l_orderkey, product(CAST(l_linenumber AS DOUBLE)) AS v FROM lineitem GROUP BY 1")
def a14_user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own aggregate; groups are the few lines of an order."""

    def product(v: pd.Series) -> float:
        return float(np.nanprod(v.to_numpy()))

    product.__annotations__ = {"v": pd.Series, "return": float}
    return rd.reduce_user(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("v")), "v", product, ["l_orderkey"], "double")


@query(
    f"WITH {RANK_LOADS}, t AS (SELECT rank, sum(load) AS load FROM rankloads GROUP BY 1), w AS (SELECT rank, 1 - load / (SELECT 1.01 * max(load) FROM t) AS w FROM t), "
    "c AS (SELECT rank, sum(w) OVER (ORDER BY rank) / sum(w) OVER () AS cmf FROM w), d AS (SELECT c_custkey AS id, (c_custkey % 997 + 0.5) / 1000.0 AS u FROM customer) "
    "SELECT id, min(rank) AS rank FROM d JOIN c ON cmf >= u GROUP BY 1"
)
def b06c_cmf_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = stats.rank_loads(placed(spark, sf_dir), RANKS).groupBy("rank").agg(F.sum("load").alias("load"))
    top = loads.agg(F.max("load")).first()[0]
    draws = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 997 + 0.5) / 1000.0).alias("u"))
    return rb.sample_cmf(draws, rb.cmf(loads, F.lit(1.01 * top))).select("id", "rank")


@query(
    f"WITH {RANK_LOADS}, i AS (SELECT phase, max(load) / avg(load) - 1 AS i FROM rankloads GROUP BY 1) SELECT phase, round(CASE WHEN i > 0.6 THEN 0.4 WHEN i < 0.1 THEN 0.9 ELSE 1 - i END, 9) AS threshold FROM i"
)
def f_auto_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.rank_loads(placed(spark, sf_dir), RANKS).groupBy("phase").agg(stats.imbalance(F.max("load"), F.avg("load")).alias("i"))
    return got.select("phase", F.round(auto_threshold(F.col("i"), 0.4, 0.9), 9).alias("threshold"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def t02_stream_merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch leaves its mergeable statistics, under its number, so that a repeated batch replaces its own."""
    path = _folder(spark, "stream")

    def leave(batch: DataFrame, number: int) -> None:
        parts = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("v"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
        parts.write.mode("overwrite").parquet(f"{path}/statistics/batch={number}")

    phases.each_phase(_event_stream(spark, sf_dir), [leave], f"{path}/checkpoint").awaitTermination()
    merged = spark.read.parquet(f"{path}/statistics").groupBy("event_type")
    return merged.agg(
        F.sum("n").alias("n"), F.round(F.sum("sum"), 4).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.round(F.sum("sum") / F.sum("v"), 6).alias("avg")
    )


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS sum FROM events GROUP BY 1")
def t03_stream_element_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that keep state between micro-batches; what each said last."""
    path = _folder(spark, "stream")
    said = phases.element_state(_event_stream(spark, sf_dir).select("user_id", "value"))

    def leave(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/said/batch={number}")

    run = said.writeStream.outputMode("update").foreachBatch(leave).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{path}/said").groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("sum", "batch").alias("sum"))
    return last.select("user_id", "n", F.round("sum", 4).alias("sum"))
