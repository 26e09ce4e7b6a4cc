"""Intermediate tables: Parquet in the folder that driver and executors share, without lineage and with true sizes.

A table read back from files is sized by its files, however long the plan that made it, and outlives a
lost executor. What is cut inside `scratch` is removed when it ends, but for what it is told to keep; the
rest goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be broadcast, counted before.
BROADCAST_BYTES = 8 << 20
#: Rows of one key that a task of a spread join takes, unless so many keys had more that they could not be broadcast.
SPREAD_ROWS = 1000
HOT_KEYS = 100_000

_open: contextvars.ContextVar[list | None] = contextvars.ContextVar("open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of the machine's own is made in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared one, removed when the scratch that is open ends, else when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    mine = _open.get()
    if mine is not None:
        mine.append(path)
    else:
        _at_end(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_left: dict[str, SparkSession] = {}


def _at_end(spark: SparkSession, path: str) -> None:
    if not _left:
        atexit.register(_sweep)
    _left[path] = spark


def _sweep() -> None:
    for path, spark in _left.items():
        with contextlib.suppress(Exception):  # the session may have ended before: its folder's owner clears it then
            if os.path.isdir(path.removeprefix("file:")):
                shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
            else:
                remove(spark, path)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """df computed once and read back from the shared folder, parted by a column of few values if one is named."""
    spark = df.sparkSession
    path = new_dir(spark, "cut")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what was cut inside; the function it gives computes a frame and keeps it."""
    outer, mine, kept = _open.get(), [], set()

    def keep(df: DataFrame) -> DataFrame:
        out = df if getattr(df, "_cut_path", None) in mine else cut(df)
        kept.add(out._cut_path)
        return out

    token = _open.set(mine)
    try:
        yield keep
    finally:
        _open.reset(token)
        for path in mine:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)
            else:
                _at_end(spark, path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of n rows at most in what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bytes(c: str, kind: T.DataType) -> tuple[int, list]:
    """Bytes of a value of fixed size, and columns that count the rest."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16, [F.octet_length(c)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return 24, [F.size(c) * (2 if isinstance(kind.elementType, T.ShortType) else 8)]
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return 32, [F.octet_length(F.to_json(c)) * 2]
    return 8, []


def byte_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of df as unsafe rows, counted."""
    fixed, rest = 16, []
    for f in df.schema.fields:
        own, more = _bytes(f"`{f.name}`", f.dataType)
        fixed, rest = fixed + own, rest + more
    total = sum((F.coalesce(x, F.lit(0)) for x in rest), F.lit(0).cast("long"))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()
    return row.n, row.n * fixed + row.b


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted bytes pass limit nowhere; else as it is, for a shuffle."""
    return F.broadcast(df) if byte_size(df)[1] <= limit else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counted: DataFrame | None = None, broadcast: bool = True) -> DataFrame:
    """left joined to right on columns that both have: right by broadcast where its bytes allow; else (or with broadcast=False,
    for a side that grows with left) by a shuffle in which the rows of a key that left holds often are dealt over several
    tasks, and right's rows of it copied to each.

    No key of right should be frequent; equal rows of left stay together. counted: a frame that is cheaper to
    read than left and holds its keys as often. An inner, left, left_semi or left_anti join.
    """
    if broadcast and byte_size(right)[1] <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    counts = (left if counted is None else counted).groupBy(*on).agg(F.count("*").alias("__n"))
    counts = cut(counts.where(F.col("__n") > SPREAD_ROWS))
    # keys so frequent are HOT_KEYS at most
    per = max(SPREAD_ROWS, (counts.agg(F.sum("__n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("__n") > per).select(*on, F.ceil(F.col("__n") / per).cast("int").alias("__parts")))
    same = F.xxhash64(*(F.col(f"`{c}`") for c in left.columns))
    one = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(same, F.col("__parts"))).cast("int")).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    two = right.join(hot, on, "left").withColumn("__salt", copies).drop("__parts").hint("merge")
    return one.join(two, [*on, "__salt"], how).drop("__salt")
