"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.storage import kept, shared_dir

__all__ = ["kept", "kept_small", "kept_lean", "shared_dir", "scratch", "dropped", "pieces", "ascii_lower", "n_words", "unit_random", "running_total", "WORD"]

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept_small(df: DataFrame, name: str, size: int = 16 << 20) -> DataFrame:
    """kept_lean(), with Arrow batches of so many bytes at most while it runs: Python workers hold a few of them beside their own tables."""
    with _set(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(size)):
        return kept_lean(df, name)


def kept_lean(df: DataFrame, name: str) -> DataFrame:
    """kept(), and the shuffle files of its own execution are deleted as it ends, not when the driver next collects garbage."""
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return kept(df, name)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folders that kept() wrote for df, which nothing may read after this."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows and bytes, or to single rows: whole texts may be long, and Python strings or arrays, a
    multiple of their size, are made of one piece at a time. What Arrow has freed goes back to the system after each batch."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if n <= 1 or (n <= rows and batch.nbytes <= size):
            yield batch
        else:
            yield from cut(batch.slice(0, n // 2))
            yield from cut(batch.slice(n // 2))

    for batch in batches:
        if batch.num_rows:
            yield from cut(batch)
        pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """How many runs of characters other than blanks a text has; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def unit_random(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: the first 48 bits of an MD5 sum."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds out: the sum of size over a group's rows before this one, in the order of bucket, then of order.

    No group is collected: each (group, bucket) is summed by itself, and only the buckets' sums, one row each,
    are run through a window by group. bucket must rise with the wanted order and be fine enough for one task.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    on = F.col(bucket) == F.col("_b")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(offsets, on)
        .withColumn(out, F.col("_offset") + F.col("_in"))
        .drop("_in", "_b", "_offset", *[f"_g{i}" for i in range(len(groups))])
    )
