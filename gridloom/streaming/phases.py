"""Phases as event-time windows over streams, with the batch operators' definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from gridloom.session import ship


def phase_statistics(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count, sum, min, max and mean of value in tumbling windows; state of a window is dropped once it is late."""
    w = F.window("ts", length)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(
        F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg")
    ).select(F.col("window.start").alias("phase_start"), *keys, "n", "sum", "min", "max", "avg")


def element_state(messages: DataFrame, key: str = "user_id") -> DataFrame:
    """Stateful elements: for each key, the running number and sum of values, emitted once a micro-batch."""
    ship(messages.sparkSession)

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in parts:
            n, total = n + len(pdf), total + float(pdf.value.sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "sum": [total]})

    return messages.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, sum double", "n long, sum double", "update", GroupStateTimeout.NoTimeout)


def each_phase(stream: DataFrame, hooks: list[Callable[[DataFrame, int], None]], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs the hooks, in order, on every micro-batch, as on the end of a phase."""

    def run(batch: DataFrame, number: int) -> None:
        for hook in hooks:
            hook(batch, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
