"""Tables that may not be there yet, and removing those no longer read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_optional(spark: SparkSession, path: str, table_schema=None) -> DataFrame | None:
    """The table at `path`, or None when there is none."""
    reader = spark.read if table_schema is None else spark.read.schema(table_schema)
    try:
        found = reader.parquet(path)
        found.limit(0).count()
        return found
    except Exception as error:  # the reader raises its own analysis error for a missing path
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies, if it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
