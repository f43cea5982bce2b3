"""Token counts with a digest cache: stored counts are joined by digest, only distinct misses are encoded, then appended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import pick, release, staged
from colloquy.llm.tokens import encoder

STORED = "digest binary, n_tokens bigint, tokenizer string"


def version(tokenizer_path: str) -> str:
    """Digest of the tokenizer's file and its library's version: counts made by another one are not reused."""
    import tokenizers

    with open(tokenizer_path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def digest(text) -> F.Column:
    """Digest of the normalised content. Counts depend on every character, so normalising only turns null into empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _stored(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    counts = spark.read.schema(STORED).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
    return counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have appended the same digest


def refresh(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text") -> None:
    """Append the counts of the contents of `docs` that the cache at `cache_path` lacks. Runs one job.

    Copies are merged before and in the shuffle, so a text that fills a third of all rows is encoded once.
    """
    spark, tokenizer = docs.sparkSession, version(tokenizer_path)
    wanted = pick(docs, text=text).select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    try:
        wanted = wanted.join(_stored(spark, cache_path, tokenizer), "digest", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at, _, ends in encode.encode(batch.column("text")):
                n = pa.array(np.diff(ends, prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(at, len(ends)), n], ["digest", "n_tokens"])
        release()

    misses = wanted.dropDuplicates(["digest"]).mapInArrow(count, "digest binary, n_tokens bigint")
    misses.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").parquet(cache_path)


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of `docs`, through the cache at `cache_path`.

    Counts are the library's: special strings inside texts are special tokens, none are added. The cache is a Parquet
    folder all executors share; it is made when missing and only ever appended to, so a lost job leaves it valid.
    Null texts count as empty (0 tokens). Repeated rows, also with equal or null ids, each give one row; an empty table
    gives none; other columns are ignored.
    """
    refresh(docs, cache_path, tokenizer_path, text)
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", digest(F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
    )
    # As a table of its own, so that the join may split a digest that a third of the rows have.
    counts = staged(_stored(docs.sparkSession, cache_path, version(tokenizer_path)).join(rows.select("digest").distinct(), "digest", "left_semi"), "counts")
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
