"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

*Codes.* Vectors of length one, centred, are turned by a learned rotation (principal axes, then iterative quantisation:
the rotation that brings them closest to the corners of a cube) and cut to signs. It is fitted on a sample of at most
SAMPLE vectors, those of the least hash of their own numbers.

*Index.* A code of BITS bits is split into substrings of BYTE bits. Every block of rows has one table a substring, from
its values to the rows that have them. By the pigeonhole principle, a code within Hamming distance
m * (s + 1) - 1 of a query's has one of the m substrings within distance s of the query's: probing all values that near
in all tables retrieves every such code.

*Search.* A query probes with s = 0, 1, 2, ... and reranks what is new within the radius reached by the exact cosine of
the original vectors. It stops when codes beyond the radius are unlikely to be as near as the neighbours it has: two
vectors at an angle a differ in about a share a / pi of the bits, plus RECALL_Z standard deviations.

Equal vectors are one row of the index. Of each, the smallest k + 1 ids are kept, as no query can return more. Queries
and index rows are dealt to blocks by hash, and each pair of a block of queries and a block of the index is one task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

SAMPLE = 5_000
BITS, BYTE = 64, 8
RECALL_Z = 2.0
#: Distinct vectors in a block of the index, and in a block of queries.
INDEX_BLOCK, QUERY_BLOCK = 8_192, 4_096


def fit_rotation(sample: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x BITS) of unit vectors; dimensions beyond the vectors' own are random turns."""
    rng = np.random.default_rng(11)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    x, dim = sample - mean, sample.shape[1]
    parts, left = [], BITS
    while left > 0:
        take = min(left, dim)
        if len(x) > 1:
            axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :take]
        else:
            axes = np.eye(dim)[:, :take]
        turn = np.linalg.qr(rng.normal(size=(take, take)))[0]
        z = x @ axes
        for _ in range(rounds if len(x) > 1 else 0):
            u, _, vt = np.linalg.svd(z.T @ np.where(z @ turn >= 0, 1.0, -1.0))
            turn = u @ vt
        parts.append(axes @ turn)
        left -= take
    return mean, np.concatenate(parts, axis=1)


def codes(unit: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.packbits((unit - mean) @ axes >= 0, axis=1)


#: For s = 0, 1, ...: the substring values at Hamming distance s from 0.
_MASKS = [np.array([sum(1 << b for b in c) for c in combinations(range(BYTE), s)], dtype=np.uint8) for s in range(BYTE + 1)]


class Block:
    """Index of one block of rows."""

    def __init__(self, vectors: np.ndarray, code: np.ndarray, ids: np.ndarray):
        self.vectors, self.norms, self.ids = vectors, np.sqrt((vectors * vectors).sum(axis=1)), ids
        self.code = code.view(np.uint64)[:, 0]
        self.tables = []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(code[order, j], np.arange(257))))

    def search(self, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k nearest vectors found, and their cosines."""
        norm, whole = np.sqrt((query * query).sum()), code.view(np.uint64)[0]
        met = np.zeros(len(self.ids), dtype=bool)
        pending = np.zeros(0, dtype=np.int64)
        rows, cos = np.zeros(0, dtype=np.int64), np.zeros(0)
        for s, masks in enumerate(_MASKS):
            parts = [pending]
            for (order, ends), own in zip(self.tables, code, strict=True):
                values = own ^ masks
                parts += [order[a:b] for a, b in zip(ends[values], ends[values.astype(np.int64) + 1], strict=True) if a < b]
            new = np.concatenate(parts)
            fresh = np.zeros(len(met), dtype=bool)
            fresh[new] = True
            fresh &= ~met
            radius = len(code) * (s + 1) - 1
            near = np.flatnonzero(fresh)
            distance = np.bitwise_count(self.code[near] ^ whole)
            # codes beyond the radius wait until it has grown
            pending, near = near[distance > radius], near[distance <= radius]
            met[near] = True
            rows = np.concatenate([rows, near])
            cos = np.concatenate([cos, (self.vectors[near] * query).sum(axis=1) / (self.norms[near] * norm)])
            if len(rows) > k:
                best = np.lexsort((self.ids[rows], -cos))[:k]
                rows, cos = rows[best], cos[best]
            if len(rows) >= k:
                share = math.acos(min(1.0, max(-1.0, cos[-1]))) / math.pi
                if radius >= BITS * share + RECALL_Z * math.sqrt(BITS * share * (1 - share)):
                    break
        order = np.lexsort((self.ids[rows], -cos))
        return rows[order], cos[order]


def _matrix(table: pa.Table) -> np.ndarray:
    col = table.column("vector").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy()
    return flat.reshape(len(col), -1)


def _search(mean: np.ndarray, axes: np.ndarray, k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "found": [], "cosine": []}
        if index.num_rows and queries.num_rows:
            x, q = _matrix(index), _matrix(queries)
            unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
            ids = index.column("first").to_numpy()
            block, code = Block(x, codes(unit(x), mean, axes), ids), codes(unit(q), mean, axes)
            for i, name in enumerate(queries.column("first").to_pylist()):
                rows, cos = block.search(q[i], code[i], k)
                out["query"] += [name] * len(rows)
                out["found"] += ids[rows].tolist()
                out["cosine"] += cos.tolist()
        return pa.table({"query": pa.array(out["query"], pa.int64()), "found": pa.array(out["found"], pa.int64()), "cosine": pa.array(out["cosine"], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vec_id of queries, its k nearest of the rows of vectors (vec_id,
    embedding) but itself by cosine, nearest first, ties to the smaller vec_id; all, if there are fewer. queries holds
    vec_ids of vectors. A row whose vec_id or embedding is null, or whose embedding is empty, all zero or holds null or
    non-finite numbers, takes no part, nor does one of another length than the most frequent; if a vec_id has several
    rows, that of the least embedding counts; equal vectors are all found, by vec_id. Other columns are ignored."""
    spark: SparkSession = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where("vec_id is not null and vector is not null").where(sound)
    # a vector whose squares leave the range of doubles is brought into it, which leaves its cosines as they are
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.transform("vector", lambda x: x / largest)
    rows = rows.withColumn("vector", F.when((squares > 1e-290) & (squares < 1e290), F.col("vector")).otherwise(scaled))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 1
    rows = rows.where(F.size("vector") == dim)
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    same = F.concat(F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector")))
    rows = scratch.keep(rows.select("vec_id", same.alias("same"), "vector"))
    alone = Window.partitionBy("vec_id").orderBy("same")
    one = rows.select("vec_id", "same").withColumn("r", F.row_number().over(alone)).where("r = 1").drop("r")
    few = Window.partitionBy("same").orderBy("vec_id")
    members = scratch.keep(one.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1))
    heads = members.where("r = 1").select(F.col("vec_id").alias("first"), F.col("same").alias("s"))
    distinct = scratch.keep(rows.join(heads, (F.col("vec_id") == F.col("first")) & (F.col("same") == F.col("s"))).dropDuplicates(["first"]).select("first", "same", "vector"))
    picked = scratch.keep(one.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id"))
    total, asked = distinct.count(), picked.count()
    sample = [r.vector for r in distinct.orderBy(F.xxhash64("same"), "first").limit(SAMPLE).select("vector").collect()]
    x = np.array(sample, dtype=np.float64).reshape(len(sample), -1) if sample else np.zeros((0, dim))
    mean, axes = fit_rotation(x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x)
    n_index, n_query = max(1, -(-total // INDEX_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    block = lambda n, seed: F.pmod(F.xxhash64("first", F.lit(seed)), F.lit(n)).cast("int")
    wanted = distinct.join(picked.select("same").distinct(), "same", "left_semi").select("first", "vector")
    both = (F.col("first") + 0).alias("first"), F.col("vector").alias("vector")
    left = distinct.select(block(n_index, 1).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"), *both)
    right = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("ib2"), block(n_query, 2).alias("qb2"), *both)
    # a query's own vector is among its nearest: k others remain
    found = left.groupBy("ib", "qb").cogroup(right.groupBy("ib2", "qb2")).applyInArrow(_search(mean, axes, k + 1), "query long, found long, cosine double")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "found")
    found = scratch.keep(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    asked_ids = picked.join(distinct.select("same", F.col("first").alias("query")), "same").select(F.col("vec_id").alias("query_id"), "query")
    others = members.join(distinct.select("same", F.col("first").alias("found")), "same").select("found", "vec_id")
    ranked = asked_ids.join(found, "query").join(others, "found").where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("cosine").alias("score"))
