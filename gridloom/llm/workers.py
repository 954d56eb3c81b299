"""Python workers that give their memory back.

Workers live on between tasks and stages, and the C library and Arrow keep what was freed in them. On an executor whose
workers have done several kinds of work that adds up, so each task ends by returning it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import SparkSession

from gridloom.session import ship

#: Bytes of a batch of rows on its way to a worker or back: rows here are whole texts, and the JVM and the worker hold a
#: batch each, several times over.
BATCH_BYTES = 4 << 20
#: Bytes of a batch that a worker sends back, about: the JVM holds it outside its heap, and does not return that memory.
PIECE_BYTES = 1 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: this package on the executors, and batches of a bounded size. A smaller
    bound of the session's own stays."""
    ship(spark)
    now = spark.conf.get(_SETTING, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch by slices of about PIECE_BYTES, or one row if that is longer."""
    step = max(1, b.num_rows * PIECE_BYTES // max(1, b.nbytes))
    for lo in range(0, b.num_rows, step):
        yield b.slice(lo, step)


def tidy(run: Run) -> Run:
    """A function for mapInArrow that returns its memory when its task ends."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in run(batches):
                yield from pieces(b)
        finally:
            release()

    return tidied
