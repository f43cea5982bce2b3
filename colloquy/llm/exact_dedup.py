"""Exact deduplication on DataFrame functions: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import pick, staged

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content_hash: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and nth for every row, dropped ones too.

    Rows are equal when their normalised texts are. Grouping by (hash, bytes) compares bytes inside each hash group and is
    combined before the shuffle, so a text that fills a third of all rows leaves each task as one row. What a hash group
    holds, one small row each, is written to the shared folder (that runs a job) and joined back by hash; only hashes that
    turn out to stand for several texts are joined by their bytes too.

    Null texts equal empty ones. A null id is larger than any other. Of rows with equal id and text, one (nth = 1) is kept.
    An empty table gives no rows; other columns are ignored.
    """
    norm = normalised(F.col("text"))
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", norm.alias("norm"))
    hashed = rows.withColumn("hash", content_hash(F.col("norm")))
    texts = hashed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = staged(
        texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        "dedup-groups",
    )
    slim = hashed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    same_row = Window.partitionBy("doc_id", "hash", "text_sha256").orderBy("doc_id")
    single = groups.where("n_texts = 1").drop("n_texts")
    out = slim.withColumn("nth", F.row_number().over(same_row)).join(single, "hash")
    mixed = groups.where("n_texts > 1").select("hash")
    if not mixed.isEmpty():
        inside = hashed.join(mixed, "hash", "left_semi")
        exact = inside.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        numbered = inside.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "hash", "norm").orderBy("doc_id")))
        rest = numbered.join(exact, ["hash", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        out = out.unionByName(rest.select(out.columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "nth")
