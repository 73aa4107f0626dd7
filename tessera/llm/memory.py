"""Python workers outlive their tasks: what one operator keeps in a worker goes when another one's task begins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Each owner's way to drop what it keeps in this process.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Registers that ``owner`` keeps something in this process; what others keep is dropped."""
    for name in [n for n in _KEPT if n != owner]:
        _KEPT.pop(name)()
        gc.collect()
    _KEPT[owner] = drop


def give_back() -> None:
    """Hands memory that the allocators hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def frugal(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for mapInArrow, giving memory back when a task ends; an ``owner`` that keeps nothing still has others' dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if owner:
            keeps(owner, lambda: None)
        yield from step(batches)
        give_back()

    return run


#: Rows of an Arrow batch: Spark's default, and what operators here ask for.
_ROWS = ("10000", "4000", "1000")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts go to Python in Arrow batches of so many rows, fewer than Spark's default, unless the session has chosen its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, _ROWS[0]) in _ROWS:
        spark.conf.set(name, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is computed inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
