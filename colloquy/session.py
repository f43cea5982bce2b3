"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (UTC, adaptive execution)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def listed_rows(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """A table of the caller's list, `columns` as "name type, ...". Unlike a list given to createDataFrame it takes no Python workers."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(","))]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, else a fresh one on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the checkpoint folder (sinks and streaming state)."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
