"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import cut, new_dir, shared_dir, small
from lodestone.shipping import ship

__all__ = ["cut", "new_dir", "shared_dir", "small"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_code_point(c: str) -> Column:
    """Sort key: by code point (bytes of UTF-8), null last."""
    return F.col(c).asc_nulls_last()


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; nothing else changes."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of n rows at most, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_held: dict[str, Callable[[], None]] = {}


def worker_runs(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where an operator's code begins in a worker: frees what other operators hold in it and gives memory that is free back to the machine. clear frees the owner's own."""
    for name in [n for n in _held if n != owner]:
        _held.pop(name)()
        gc.collect()
    if clear is not None:
        _held[owner] = clear
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
