"""JSON files of one large array, read element by element by as many tasks as the file has splits.

The text reader cuts files at any separator, also where a split ends. With `{` as the separator every object's start is the
start of a row, and no escape is cut, for in JSON a backslash never stands before a brace. Whether a row starts inside a
string follows from the quotes before it, and its depth from the brackets outside strings before it. Inside a split both are
summed up for a split that starts outside strings and for one that starts inside; the splits' totals then tell which holds.
Rows from one start at the elements' depth to the next are one element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.session import shared_folder

_LINE = ["block", "pos"]
_BEFORE = (Window.unboundedPreceding, -1)


def _balance(pieces: Column) -> Column:
    """Brackets opened less brackets closed in the given pieces of text."""
    joined = F.array_join(pieces, "")
    opened = F.length(F.regexp_replace(joined, r"[^\[{]", ""))
    closed = F.length(F.regexp_replace(joined, r"[^\]}]", ""))
    return (opened - closed).cast("bigint")


def _every_second(pieces: Column, first: int) -> Column:
    return F.filter(pieces, lambda _, i: i % 2 == first)


def _pieces(spark: SparkSession, path: str | list[str], pattern: str, options: dict) -> DataFrame:
    """Rows between braces; quotes and depth before each in its split, the depth for a start outside (0) and inside (1) strings."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "{")
    rows = reader.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
    inside = Window.partitionBy("path", "block").orderBy("pos")
    rows = rows.withColumn("_p", F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')).select(
        "path", "block", "value", "modified_at", F.row_number().over(inside).alias("pos"),
        (F.size("_p") - 1).cast("bigint").alias("_quotes"),
        F.array(*[_balance(_every_second(F.col("_p"), k)) for k in (0, 1)]).alias("_balance"),
        F.col("value").rlike(r"\A\s*\z").alias("_blank"),
    )
    rows = rows.withColumn("_q", F.coalesce(F.sum("_quotes").over(inside.rowsBetween(*_BEFORE)), F.lit(0)))
    # Each row's text follows a brace, except for the first row of a file.
    brace = ~((F.col("block") == 0) & (F.col("pos") == 1))
    for start in (0, 1):
        state = ((F.col("_q") + start) % 2).cast("int")
        change = F.when(brace & (state == 0), 1).otherwise(0) + F.get("_balance", state)
        rows = rows.withColumn(f"_change{start}", change.cast("bigint"))
    for start in (0, 1):
        rows = rows.withColumn(f"_d{start}", F.coalesce(F.sum(f"_change{start}").over(inside.rowsBetween(*_BEFORE)), F.lit(0)))
    return rows.drop("_balance")


def read_array_elements(spark: SparkSession, path: str | list[str], pattern: str = "*.json", **options) -> DataFrame:
    """The objects of each file's outermost array: path, element (from 0 in their order), value, modified_at.

    A file is one JSON value in UTF-8. An object that is not in an array is the one element of its file. Elements that are no
    objects are not counted; they stay behind the object before them, where JSON functions no longer read. A file whose
    strings or brackets do not close gives no row, an empty file neither. One element must fit into a task; files need not.

    Runs a job when called: files are read once, their pieces go to the shared folder.
    """
    stored = shared_folder(spark, "json-pieces")
    pieces = _pieces(spark, path, pattern, options)
    pieces.write.parquet(stored)
    rows = spark.read.schema(pieces.schema).parquet(stored)

    # Per split: whether it starts inside a string, the depth there, and what holds for its file.
    by_file = Window.partitionBy("path")
    earlier = by_file.orderBy("block").rowsBetween(*_BEFORE)
    splits = rows.groupBy("path", "block").agg(
        F.sum("_quotes").alias("_n"), F.sum("_change0").alias("_t0"), F.sum("_change1").alias("_t1"),
        F.bool_or((F.col("block") == 0) & (F.col("pos") == 1) & F.col("_blank")).alias("_bare"),
    )
    splits = splits.withColumn("_in", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("_in") == 0, F.col("_t0")).otherwise(F.col("_t1"))
    closed = (F.sum("_n").over(by_file) % 2 == 0) & (F.sum(change).over(by_file) == 0)
    splits = splits.select(
        "path", "block", "_in", F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("_base"), closed.alias("_closed"),
        F.when(F.bool_or("_bare").over(by_file), 0).otherwise(1).alias("_level"),
    ).where("_closed")

    depth = F.col("_base") + F.when(F.col("_in") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    begins = ~((F.col("block") == 0) & (F.col("pos") == 1)) & ((F.col("_q") + F.col("_in")) % 2 == 0) & (depth == F.col("_level"))
    marked = rows.join(splits, ["path", "block"]).withColumn("_begins", begins.cast("bigint"))
    counts = marked.groupBy("path", "block").agg(F.sum("_begins").alias("_m"))
    counts = counts.select("path", "block", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_started"))
    here = F.sum("_begins").over(Window.partitionBy("path", "block").orderBy("pos"))
    numbered = marked.join(counts, ["path", "block"]).withColumn("element", F.col("_started") + here - 1).where("element >= 0")

    texts = F.transform(F.sort_array(F.collect_list(F.struct(*_LINE, "value"))), lambda r: r.getField("value"))
    # What follows the element in its last row: a comma, or the array's end.
    whole = F.regexp_replace(F.concat(F.lit("{"), F.array_join(texts, "{")), r"[\s,\]]+\z", "")
    return numbered.groupBy("path", "element").agg(whole.alias("value"), F.max("modified_at").alias("modified_at"))
