"""The model's tables as they are derived from the driver's, in Spark and in SQL.

Objects are suppliers, phases are months of shipment, loads are whole cents; ranks are blocks of objects on RANKS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import index as ix

RANKS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: str = "l_extendedprice"):
    return F.round(F.col(price) * 100).cast("long")


def phase(date: str = "l_shipdate"):
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(phase().alias("phase"), F.col("l_suppkey").cast("long").alias("object"), cents().alias("c"))
    return rows.groupBy("phase", "object").agg(F.sum("c").alias("load"))


def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the number of suppliers."""
    return F.broadcast(table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_objects")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(loads(spark, sf_dir), sf_dir)


def ranked(objects: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the rank of their object."""
    rows = objects.crossJoin(extent(objects.sparkSession, sf_dir))
    return rows.withColumn("rank", ix.block_map(F.col("object"), F.col("n_objects"), RANKS)).drop("n_objects")


def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object")).crossJoin(extent(spark, sf_dir))
    return rows.select("object", ix.block_map(F.col("object"), F.col("n_objects"), RANKS).alias("rank"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a line's supplier to one that its part number stands for; the line status gives the category."""
    rows = table(spark, sf_dir, "lineitem").crossJoin(extent(spark, sf_dir))
    category = F.when(F.col("l_linestatus") == "O", "SendRecv").otherwise("Broadcast")
    rows = rows.select(
        category.alias("category"), F.col("l_suppkey").alias("from_object"), (F.col("l_partkey") % F.col("n_objects")).alias("to_object"),
        phase().alias("phase"), cents().alias("c"),
    )
    return rows.groupBy("phase", "category", "from_object", "to_object").agg(F.sum("c").alias("bytes"), F.count("*").alias("messages"))


def block_sql(i: str, n: str, p: int = RANKS) -> str:
    return (
        f"CASE WHEN {i} < ({n} % {p}) * ({n} // {p} + 1) THEN {i} // ({n} // {p} + 1) "
        f"WHEN {i} < {n} AND {n} // {p} > 0 THEN {n} % {p} + ({i} - ({n} % {p}) * ({n} // {p} + 1)) // ({n} // {p}) ELSE {i} % {p} END"
    )


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
PHASE = "CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT)"
N_OBJECTS = "(SELECT count(*) FROM supplier)"
LOADS = f"loads AS (SELECT {PHASE} AS phase, l_suppkey AS object, CAST(sum({CENTS}) AS BIGINT) AS load FROM lineitem GROUP BY 1, 2)"
PLACED = f"{LOADS}, placed AS (SELECT phase, object, load, CAST({block_sql('object', N_OBJECTS)} AS BIGINT) AS rank FROM loads)"
PLACEMENT = f"placement AS (SELECT s_suppkey AS object, CAST({block_sql('s_suppkey', N_OBJECTS)} AS BIGINT) AS rank FROM supplier)"
EDGES = (
    "edges AS (SELECT " + PHASE + " AS phase, CASE WHEN l_linestatus = 'O' THEN 'SendRecv' ELSE 'Broadcast' END AS category, l_suppkey AS from_object, "
    f"l_partkey % {N_OBJECTS} AS to_object, CAST(sum({CENTS}) AS BIGINT) AS bytes, count(*) AS messages FROM lineitem GROUP BY 1, 2, 3, 4)"
)
PLACED_EDGES = f"{PLACEMENT}, {EDGES}, pedges AS (SELECT e.*, a.rank AS from_rank, b.rank AS to_rank FROM edges e JOIN placement a ON a.object = e.from_object JOIN placement b ON b.object = e.to_object)"
RANK_LOADS = (
    f"{PLACED}, rankloads AS (SELECT p.phase, CAST(r.rank AS BIGINT) AS rank, CAST(coalesce(sum(l.load), 0) AS BIGINT) AS load FROM (SELECT DISTINCT phase FROM loads) p "
    f"CROSS JOIN (SELECT range AS rank FROM range({RANKS})) r LEFT JOIN placed l ON l.phase = p.phase AND l.rank = r.rank GROUP BY 1, 2)"
)


def moments_sql(x: str, n: str = "count(*)") -> str:
    """The statistics by power sums, independent of any engine's skewness and kurtosis."""
    return (
        f"round(max({x}), 6) AS max, round(sum({x}), 6) AS sum, round(min({x}), 6) AS min, round(avg({x}), 6) AS avg, "
        f"round(coalesce(max({x}) / nullif(avg({x}), 0) - 1, 0), 6) AS I, count(*) FILTER (WHERE {x} <> 0) AS npr, count(*) AS car"
    )
