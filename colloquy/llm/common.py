"""Helpers shared by the operators: columns by exact name, tables in the shared folder, numbering without a hot window."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.session import prepare as base_settings
from colloquy.session import shared_folder

ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that leave room for what the operators make of whole texts."""
    base_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names; other columns, also such as differ in case only, are out of the way."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"c{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared checkpoint folder and read it back.

    Runs a job at once. Cuts the lineage: a lost executor costs no more than the tasks that read it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run below a new folder of the shared one, each removed when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_folder(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written as the table `name` and read back. Runs a job at once."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Remove a table, if it is there; all that was made of it must be written by now."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache(key: Any, build: Callable[[], Any]) -> Any:
    """What `build` made for `key` in this Python worker; functions shipped by value have no module globals to keep it in."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def release() -> None:
    """Give memory that a task no longer needs back to the system; the worker lives on and would else keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def n_buckets(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets so that each holds about `per_bucket` rows at most, whatever the input's size."""
    return max(LEAST_BUCKETS, -(-rows // per_bucket))


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before each one in its group, in the order (bucket, *order).

    `df` is read twice, so it should be a staged table. No window holds more than one bucket of a group; the
    buckets' totals, one row for each group and bucket, are summed in a second small step. Nulls in `groups` form a group.
    """
    keys = [*groups, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__before")
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, same)
        .withColumn(out, F.col("__before") + F.col("__inside")).select(*df.columns, out)
    )
