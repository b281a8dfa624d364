"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession


@contextmanager
def tidy() -> Iterator[None]:
    """At the end of a task's loop, freed memory goes back to the system instead of staying with the idle worker."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def tidied(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that tidies up after each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            yield from run(batches)

    return each


@contextmanager
def small_texts(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes for the jobs that run inside: whole texts make large ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
