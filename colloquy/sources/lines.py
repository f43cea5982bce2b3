"""Line files with a stable order, and the pieces the readers share.

A line's place is (path, block, pos): `block` is the start of the file split it came from and
`pos` grows inside the split, so large files stay splittable and the order of lines is known
without reading a file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.operators.messages import canonicalize
from colloquy.operators.ranking import number_rows

LINES = "path string, block bigint, pos bigint, value string, modified_at timestamp"


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl", **options) -> DataFrame:
    """Lines of all files below `path` with their place and the file's modification time."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """`pos` as the line's number in its file block: the same in every run. A block is never longer than a file split."""
    inside = Window.partitionBy("path", "block").orderBy("pos")
    return lines.withColumn("pos", F.row_number().over(inside).cast("bigint") - 1)


def read_documents(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """Whole files as one text each; for formats where one file is one JSON value."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.option("wholetext", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column, levels_up: int = 1) -> Column:
    """Name of the directory `levels_up` above the file."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-1 - levels_up)), F.lit(""))


def block_text(content: Column) -> Column:
    """Text of message content given as JSON: a string, a list of strings, or typed text blocks."""
    blocks = F.from_json(content, "array<string>")
    texts = F.transform(
        F.filter(
            blocks,
            lambda b: ~F.ltrim(b).startswith("{") | (F.get_json_object(b, "$.type") == "text"),
        ),
        lambda b: F.when(F.ltrim(b).startswith("{"), F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(b),
    )
    return F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).otherwise(content)


def once(value: Column) -> Column:
    """The value as a one-element generator.

    Filters on a generated column stay above the generator, so a costly expression is evaluated
    once instead of again in every filter that uses it.
    """
    return F.explode(F.array(value))


#: Where a message stands in its files, and whether its id is its own: what numbering needs besides the message.
PLACES = "path string, block bigint, pos bigint, has_id boolean"


def placed_messages(rows: DataFrame, as_of: Column) -> DataFrame:
    """Canonical messages with their places, not yet numbered; rows as in `to_messages`."""
    ready = canonicalize(rows.withColumn("has_id", F.col("message_id").isNotNull()), as_of)
    return ready.select(*[f.name for f in schema.MESSAGES.fields], "path", "block", "pos", "has_id")


def number_messages(placed: DataFrame) -> DataFrame:
    """Number every conversation of `placed_messages` in the order of its places; places stay.

    Ids missing from the input become conversation id and position.
    """
    numbered = number_rows(
        placed.drop("msg_index", "conversation_msg_count"),
        ["conversation_id"], ["path", "block"], ["pos"], "msg_index", "conversation_msg_count",
    )
    own = F.concat_ws("_", "conversation_id", "msg_index")
    return (
        numbered.withColumn("message_id", F.when(F.col("has_id"), F.col("message_id")).otherwise(own))
        .withColumn("is_first", (F.col("msg_index") == 0).cast("int"))
        .withColumn("is_last", (F.col("msg_index") == F.col("conversation_msg_count") - 1).cast("int"))
        .select(*placed.columns)
    )


def to_messages(rows: DataFrame, as_of: Column) -> DataFrame:
    """Canonical, numbered messages of rows in file order.

    rows: path, block, pos, conversation_id, role, content, ts (nullable) and optional columns.
    """
    return schema.conform(number_messages(placed_messages(rows, as_of)), schema.MESSAGES)


def moment(as_of) -> Column:
    """The time given to rows without one: a value of the caller's, or the time of the run."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
