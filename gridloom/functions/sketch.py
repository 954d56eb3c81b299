"""A streaming histogram sketch of centroids, and simple regression.

The sketch keeps at most `size` centroids (value, count, exact). A value joins an equal centroid or becomes one; while
there are too many, the closest two become their weighted mean, which is no longer exact. Ranks and quantiles are those
of trapezoids between neighbouring centroids, after Ben-Haim and Tom-Tov, and the true ones where the neighbours are
exact. A sketch is an array<struct<value: double, count: bigint, exact: boolean>> column, so sketches are stored, merged
and queried as data."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import ship

Centroids = list[tuple[float, int, bool]]
SKETCH = "array<struct<value:double,count:bigint,exact:boolean>>"


def pared(values: np.ndarray, counts: np.ndarray, exact: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct centroids, reduced to `size`. A round merges the closest pairs that share no centroid, half of
    those in excess at most, so that a long list takes few rounds; the last ones go one at a time."""
    while (excess := len(values) - size) > 0:
        taken = np.zeros(len(values), dtype=bool)
        left = []
        for k in np.argsort(np.diff(values), kind="stable"):
            if not (taken[k] or taken[k + 1]):
                taken[k : k + 2] = True
                left.append(k)
                if len(left) >= max(1, excess // 2):
                    break
        left = np.array(left)
        total = counts[left] + counts[left + 1]
        values, counts, exact = values.copy(), counts.copy(), exact.copy()
        values[left] = (values[left] * counts[left] + values[left + 1] * counts[left + 1]) / total
        counts[left], exact[left] = total, False
        keep = np.ones(len(values), dtype=bool)
        keep[left + 1] = False
        values, counts, exact = values[keep], counts[keep], exact[keep]
    return values, counts, exact


def merged(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sketch of several; a centroid is exact if all that went into it are."""
    values, counts, exact = (np.concatenate(c) for c in zip(*parts, strict=True))
    distinct, which = np.unique(values, return_inverse=True)
    rough = np.bincount(which, ~exact, len(distinct)) > 0
    return pared(distinct, np.bincount(which, counts, len(distinct)).astype(np.int64), ~rough, size)


def build(values: Iterable[float], size: int) -> Centroids:
    """Of a few values in their order, one at a time."""
    out = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))
    for v in values:
        out = merged([out, (np.array([float(v)]), np.array([1]), np.array([True]))], size)
    return [(float(v), int(n), bool(e)) for v, n, e in zip(*out, strict=True)]


def _neighbours(cents: Centroids, k: int, low: float, high: float) -> tuple[tuple[float, int, bool], tuple[float, int, bool]]:
    """The centroids on both sides of place k, with empty ones at the ends of the data."""
    return cents[k - 1] if k else (low, 0, True), cents[k] if k < len(cents) else (high, 0, True)


def estimate_rank(cents: Centroids, value: float, low: float, high: float) -> float:
    """About how many values are at or below a value."""
    if not cents or value < low:
        return 0.0
    if value >= high:
        return float(sum(c[1] for c in cents))
    k = sum(c[0] <= value for c in cents)
    (at, left, sure), (to, right, also) = _neighbours(cents, k, low, high)
    below = sum(c[1] for c in cents[: max(k - 1, 0)])
    if sure and (also or at == value):
        return float(below + left)
    share = (value - at) / (to - at)
    return below + left / 2 + (left + (left + (right - left) * share)) * share / 2


def quantile(cents: Centroids, q: float, low: float, high: float) -> float | None:
    """The value below which a share q of the values is, about; null for an empty sketch."""
    if not cents:
        return None
    want = q * sum(c[1] for c in cents)
    ends = list(accumulate(c[1] for c in cents))
    middles = [end - c[1] / 2 for end, c in zip(ends, cents, strict=True)]
    k = sum(m <= want for m in middles)
    (at, left, sure), (to, right, also) = _neighbours(cents, k, low, high)
    if sure and also:
        return to
    area = want - (middles[k - 1] if k else 0.0)
    # left * z + (right - left) * z * z / 2 = area
    if left == right:
        return at + (to - at) * area / left
    slope = right - left
    return at + (to - at) * (math.sqrt(max(left * left + 2 * slope * area, 0.0)) - left) / slope


def _arrays(cell: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(cell.field(c).to_numpy(zero_copy_only=False) for c in ("value", "count", "exact"))


def _cell(sketch: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[dict]:
    return [{"value": float(v), "count": int(n), "exact": bool(e)} for v, n, e in zip(*sketch, strict=True)]


def _together(by: list[str], size: int):
    cols = [*by, "sketch", "low", "high"]

    def run(table: pa.Table) -> pa.Table:
        # in order of their content, so that the order of tasks does not matter
        parts = sorted((_arrays(x.values) for chunk in table.column("sketch").chunks for x in chunk), key=lambda p: (len(p[0]), *p[0], *p[1]))
        held = parts[0]
        for part in parts[1:]:
            held = merged([held, part], size)
        out = {c: [table.column(c)[0].as_py()] for c in by} | {"sketch": [_cell(held)], "low": [min(table.column("low").to_pylist())], "high": [max(table.column("high").to_pylist())]}
        return pa.table({c: pa.array(out[c], type=table.schema.field(c).type) for c in cols})

    return run


def _schema(df: DataFrame, by: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"sketch {SKETCH}", "low double", "high double"])


def sketches(df: DataFrame, value: str, by: list[str], size: int) -> DataFrame:
    """Rows (by..., sketch, low, high) of the values that are numbers. Each task builds sketches of its own rows, so that
    what is shuffled is one small sketch a task and group; those are merged by lanes and then in all."""
    ship(df.sparkSession)
    cols = [*by, "sketch", "low", "high"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            pdf = b.to_pandas()
            pdf = pdf[pdf[value].notna()]
            for key, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                values, counts = np.unique(part[value].to_numpy(dtype=np.float64), return_counts=True)
                if len(values):
                    key = tuple(None if k != k else k for k in key)
                    old = held.get(key)
                    own = (values, counts.astype(np.int64), np.ones(len(values), dtype=bool))
                    low, high = (min(old[1], values[0]), max(old[2], values[-1])) if old else (values[0], values[-1])
                    held[key] = [merged([old[0], own] if old else [own], size), float(low), float(high)]
        rows = {c: [key[i] for key in held] for i, c in enumerate(by)}
        rows |= {"sketch": [_cell(x[0]) for x in held.values()], "low": [x[1] for x in held.values()], "high": [x[2] for x in held.values()]}
        kinds = {"sketch": pa.list_(pa.struct([("value", pa.float64()), ("count", pa.int64()), ("exact", pa.bool_())])), "low": pa.float64(), "high": pa.float64()}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], type=kinds.get(c) or b.schema.field(c).type) for c in cols], cols)

    number = F.col(value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(number), number).alias(value))
    parts = rows.mapInArrow(local, _schema(df, by))
    lanes = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy(*by, "lane").applyInArrow(_together(by, size), _schema(df, by))
    return merge_sketches(lanes, by, size)


def merge_sketches(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """One row (by..., sketch, low, high) for each group of rows that have these columns."""
    ship(rows.sparkSession)
    return rows.withColumn("all", F.lit(1)).groupBy(*by, "all").applyInArrow(_together(by, size), _schema(rows, by))


def query_sketches(rows: DataFrame, quantiles: list[float], values: list[float] = ()) -> DataFrame:
    """The rows of sketches() with columns quantiles and ranks (of the values)."""
    ship(rows.sparkSession)
    schema = _schema(rows, [f.name for f in rows.schema if f.name not in ("sketch", "low", "high")]) + ", quantiles array<double>, ranks array<double>"
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [[(x["value"], x["count"], x["exact"]) for x in c] for c in b.column("sketch").to_pylist()]
            ends = list(zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True))
            got = {
                "quantiles": pa.array([[quantile(c, q, *e) for q in quantiles] for c, e in zip(cells, ends, strict=True)], pa.list_(pa.float64())),
                "ranks": pa.array([[estimate_rank(c, v, *e) for v in values] for c, e in zip(cells, ends, strict=True)], pa.list_(pa.float64())),
            }
            yield pa.RecordBatch.from_arrays([got[c] if c in got else b.column(c) for c in names], names)

    return rows.mapInArrow(ask, schema)


def fixed_buckets(df: DataFrame, value: str, by: list[str], n: int) -> DataFrame:
    """Exact numbers of values in n buckets of equal width from least to largest, the upper edge belonging to a bucket."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    # without groups the ends are one row; else Spark decides by their size
    rows = df.join(ends, by) if by else df.join(F.broadcast(ends))
    width = (F.col("__hi") - F.col("__lo")) / n
    bucket = F.when(width > 0, F.greatest(F.ceil((F.col(value) - F.col("__lo")) / width) - 1, F.lit(0))).otherwise(0)
    return rows.withColumn("bucket", F.least(bucket, F.lit(n - 1)).cast("long")).groupBy(*by, "bucket").agg(F.count("*").alias("count"))


def regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares slope and intercept; null where all x are one."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
