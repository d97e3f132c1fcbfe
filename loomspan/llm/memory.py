"""Memory of the tasks' Python: Arrow batches of a bounded size, and workers that give back what a task has freed."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, whatever the table; a longer row stands alone. The JVM keeps a batch outside of its heap, the worker a copy and arrays made from it.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session so that a batch that goes to Python is small, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system, which Arrow and the C library would else keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """``f`` of a task's batches; what it has freed goes back at the task's end. A worker outlives its task, and what it holds idle adds to that of the stages that follow."""

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        give_back()

    return run


def tidy_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` of one group, as ``tidy``."""

    @functools.wraps(f)
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run
