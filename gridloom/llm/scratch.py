"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.workers import prepare
from gridloom.session import shared_dir

#: Rows of a few longs that one side of a join may have to be broadcast (some tens of MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """Writes tables as Parquet and reads them again, which cuts their lineage: a lost executor costs one table's
    unfinished part and not what came before it."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            if path := t.__dict__.pop("_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, size: int | None = None) -> DataFrame:
    """Marks a kept table of a few longs for broadcast if it holds no more than BROADCAST_ROWS numbers or rows of some:
    `size` where rows hold arrays, else its counted rows."""
    return F.broadcast(df) if (df.count() if size is None else size) <= BROADCAST_ROWS else df
