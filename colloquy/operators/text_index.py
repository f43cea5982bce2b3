"""A stored full-text index: postings by term, document lengths, and block maxima for an early stop.

    <path>/postings/bucket=B   blocks of at most BLOCK postings of one term: ids, how often, document lengths; and of the
                               block: how many, the most often, the least length
    <path>/documents           id and length of every document
    <path>/totals              documents and words of each call that added some, and the number of buckets

A term's postings go by how often it stands there, then by the length of the document, so that a block's bound (its most and
its least) is near what its postings give to a score. Scores depend on statistics of all documents, which change as documents
are added; blocks hold counts, and bounds follow from them and today's statistics.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import fulltext
from colloquy.operators.matching import tokens
from colloquy.operators.ranking import top_per
from colloquy.session import shared_folder
from colloquy.sources.tables import remove

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

BLOCK = 1_024
#: Words of text to a bucket, about; buckets, at least and at most.
BUCKET_WORDS, LEAST_BUCKETS, MOST_BUCKETS = 10_000_000, 16, 4_096
#: What rounding may take off a bound.
SLACK = 1e-6


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _postings_schema(id_type: str) -> str:
    return f"term string, ids array<{id_type}>, tfs array<int>, lengths array<bigint>, n bigint, most int, least bigint, bucket int"


def build_text_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", buckets: int | None = None) -> None:
    """Index `docs` at `path`, which is made anew. Rows that share an id are one document; rows without an id are left out.

    The number of buckets follows that of the words unless it is given, and stays when documents are added.
    """
    _add(docs, path, id_col, text_col, "overwrite", buckets)


def add_to_text_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """Index further documents; what is there is not read but for its ids. Ids that are there already stay as they are."""
    spark, step = docs.sparkSession, shared_folder(docs.sparkSession, "text-index-known")
    known = spark.read.parquet(f"{path}/documents").select(F.col("id").alias("_known"))
    # only ids are compared, so that texts stay where they are unless very many of them are known
    known.join(docs.select(F.col(id_col).alias("_id")), F.col("_known") == F.col("_id"), "left_semi").write.parquet(step)
    both = spark.read.parquet(step)
    new = docs if both.isEmpty() else docs.join(both, F.col(id_col) == F.col("_known"), "left_anti")
    _add(new, path, id_col, text_col, "append", _totals(spark, path)[2])
    remove(spark, step)


def _totals(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Documents, words and buckets of an index."""
    return tuple(spark.read.parquet(f"{path}/totals").agg(F.sum("documents"), F.sum("words"), F.max("buckets")).first())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each row's list `w` and how often they stand there, many rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            listed = part.column("w")
            tokens_, owner = pc.list_flatten(listed).dictionary_encode(), pc.list_parent_indices(listed).to_numpy().astype(np.int64)
            size = max(1, len(tokens_.dictionary))
            pairs, often = np.unique(owner * size + tokens_.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * size).astype(np.int32))
            terms = tokens_.dictionary.take(pa.array(pairs % size))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.bincount(owner, minlength=part.num_rows)), pa.ListArray.from_arrays(offsets, terms),
                 pa.ListArray.from_arrays(offsets, pa.array(often.astype(np.int32)))], ["id", "length", "terms", "tfs"])


def _pack(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: blocks of at most `size` postings from postings in order; a block begins with its term or after a full one."""
    def blocks(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        part = rows.slice(int(starts[0]), int(ends[-1] - starts[0])).combine_chunks()
        starts, n = starts - starts[0], ends - starts
        columns = {c: part.column(c).combine_chunks() for c in part.column_names}
        columns = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in columns.items()}
        offsets, first = pa.array(np.r_[starts, part.num_rows].astype(np.int32)), pa.array(starts)
        return pa.RecordBatch.from_arrays(
            [columns["term"].take(first), *(pa.ListArray.from_arrays(offsets, columns[c]) for c in ("id", "tf", "length")), pa.array(n),
             columns["tf"].take(first), pa.array(np.minimum.reduceat(columns["length"].to_numpy(), starts)), columns["bucket"].take(first)],
            ["term", "ids", "tfs", "lengths", "n", "most", "least", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            codes = rows.column("term").combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            codes = codes.indices.to_numpy()
            change = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            run_of = np.repeat(change, np.diff(np.r_[change, len(codes)]))
            starts = np.flatnonzero((np.arange(len(codes)) - run_of) % size == 0)
            # the last block may go on in the next batch
            if len(starts) > 1:
                yield blocks(rows, starts[:-1], starts[1:])
            rest = rows.slice(int(starts[-1]))
        if rest is not None:
            yield blocks(rest, np.array([0]), np.array([rest.num_rows]))

    return run


def _add(docs: DataFrame, path: str, id_col: str, text_col: str, mode: str, buckets: int | None) -> None:
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).where("id is not null")
    step = shared_folder(spark, "text-index")
    id_type = words.schema["id"].dataType.simpleString()
    # texts are read once, and a text's equal tokens merge where it is read
    words.mapInArrow(_count, f"id {id_type}, length bigint, terms array<string>, tfs array<int>").write.parquet(f"{step}/counted")
    counted = spark.read.parquet(f"{step}/counted")
    counted.groupBy("id").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("rows")).write.parquet(f"{step}/lengths")
    lengths = spark.read.parquet(f"{step}/lengths")
    documents, total, most = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // BUCKET_WORDS)))
    each = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    postings = counted
    if most > 1:
        # a document of several rows: their counts are added up, its length is that of all
        several = lengths.where("rows > 1").select(F.col("id").alias("_id"), F.col("length").alias("_length"))
        postings = counted.join(several, F.col("id") == F.col("_id"), "left_anti")
    postings = postings.select("id", "length", each).select("id", "length", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    if most > 1:
        parts = counted.join(several, F.col("id") == F.col("_id")).select("id", F.col("_length").alias("length"), each)
        postings = postings.union(parts.groupBy("id", "length", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").cast("int").alias("tf")))
    rows = postings.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "id", "tf", "length")
    order = ["bucket", "term", F.col("tf").desc(), "length", "id"]

    # ranges: a term that stands in most documents is spread over several tasks
    blocks = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack(BLOCK), _postings_schema(id_type))
    blocks.write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    lengths.drop("rows").write.mode(mode).parquet(f"{path}/documents")
    spark.createDataFrame([(documents, total, buckets)], "documents bigint, words bigint, buckets int").coalesce(1).write.mode(mode).parquet(f"{path}/totals")
    remove(spark, step)


def _asked(spark: SparkSession, queries: fulltext.Queries) -> DataFrame:
    table = queries.select("query_id", "query") if isinstance(queries, DataFrame) else spark.createDataFrame(list(queries), "query_id string, query string")
    return table.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def _needed(blocks: DataFrame, mean: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (query_id, term, idf, ids, tfs, lengths, bound) that may hold one of a query's k best, and all of them.

    Every query's k-th best score is at least that of the k-th best document in the best blocks of its terms, counted by
    that block's term alone. A document of another block has at most that block's bound and the best bounds of the other
    terms; where this is less, no document of the block is among the k best, and the block is dropped.
    """
    # the best block of each (query, term): its k-th posting is a floor for the query's k-th score
    heads = top_per(blocks, ["query_id", "term"], [F.col("bound").desc(), F.col("n").desc(), F.col("ids")[0]], 1)
    weights = F.transform(F.arrays_zip("tfs", "lengths"), lambda p: fulltext._weight(F.col("idf"), p["tfs"].cast("double"), p["lengths"], F.lit(mean)))
    floor = heads.select("query_id", F.element_at(F.sort_array(weights, asc=False), F.least(F.size(weights), F.lit(k))).alias("w"), F.size(weights).alias("n"))
    floors = floor.groupBy("query_id").agg(F.max(F.when(F.col("n") >= k, F.col("w"))).alias("floor"))
    best = blocks.groupBy("query_id", "term").agg(F.max("bound").alias("best"))
    others = best.join(best.groupBy("query_id").agg(F.sum("best").alias("all")), "query_id").select("query_id", "term", (F.col("all") - F.col("best")).alias("others"))
    judged = blocks.join(others, ["query_id", "term"]).join(floors, "query_id")
    kept = judged.where(F.col("floor").isNull() | (F.col("bound") + F.col("others") >= F.col("floor") - SLACK))
    return kept.drop("others", "floor"), judged


def search_text_index(spark: SparkSession, path: str, queries: fulltext.Queries, k: int = 10) -> DataFrame:
    """Best k documents per query by BM25: (query_id, rank, id, score), as `fulltext.bm25` over all indexed documents.

    `queries` is a list of (query_id, query) or a table. Only the buckets of the queries' terms are read, and of their
    postings only the blocks that may hold one of the k best.
    """
    blocks, mean = _asked_blocks(spark, path, queries)
    kept, _ = _needed(blocks, mean, k)
    hits = kept.select("query_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
    part = fulltext._weight(F.col("idf"), F.col("p.tfs").cast("double"), F.col("p.lengths"), F.lit(mean))
    scored = hits.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum(part), 9).alias("score"))
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank").select("query_id", "rank", "id", "score")


def _asked_blocks(spark: SparkSession, path: str, queries: fulltext.Queries) -> tuple[DataFrame, float]:
    """The blocks of the queries' terms with idf and bound, one row for each query, term and block; and the mean length."""
    n_docs, words, number = _totals(spark, path)
    mean = words / max(1, n_docs)
    asked = _asked(spark, queries).withColumn("bucket", _bucket(F.col("term"), number))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # MOST_BUCKETS at most
    id_type = spark.read.parquet(f"{path}/documents").schema["id"].dataType.simpleString()
    stored = spark.read.schema(_postings_schema(id_type)).parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))
    if not isinstance(queries, DataFrame):
        stored = stored.where(F.col("term").isin([r["term"] for r in asked.select("term").distinct().collect()]))
    else:
        stored = stored.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    df = stored.groupBy("term").agg(F.sum("n").alias("df")).select("term", fulltext._idf(F.lit(n_docs), F.col("df")).alias("idf"))
    bound = fulltext._weight(F.col("idf"), F.col("most").cast("double"), F.col("least"), F.lit(mean))
    return stored.drop("bucket").join(asked.drop("bucket"), "term").join(df, "term").withColumn("bound", bound), mean
