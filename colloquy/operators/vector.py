"""Vector search: exact batched top-k, approximate search, encoders and their bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import noise
from colloquy.operators import vector_index
from colloquy.operators.ranking import top_per
from colloquy.session import shared_folder

# Queries sent to the tasks of one pass; larger query tables take several passes.
QUERIES_PER_PASS = 2_000



def similarity(distance):
    """1 / (1 + squared L2 distance)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def _query_passes(queries) -> list[list[tuple]]:
    """Queries in lists small enough to ship to every task."""
    if not isinstance(queries, DataFrame):
        rows = [(q, list(v)) for q, v in queries]
        return [rows[i : i + QUERIES_PER_PASS] for i in range(0, len(rows), QUERIES_PER_PASS)]
    table = queries.select("query_id", "vector").where("vector IS NOT NULL").persist()
    try:
        n = table.count()
        passes = max(1, -(-n // QUERIES_PER_PASS) * 2 if n > QUERIES_PER_PASS else 1)
        out = []
        for i in range(passes):
            part = table.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            out.append([(r[0], list(r[1])) for r in part.collect()])
        return out
    finally:
        table.unpersist()


def _nearest_in_partition(rows: list[tuple], k: int, query_type: pa.DataType, digits: int | None = None) -> Callable:
    """Task function: the k nearest ids of every query among one partition's vectors."""
    names = [q for q, _ in rows]
    matrix = np.asarray([v for _, v in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in names]
        bound = np.full(len(names), np.inf)
        id_type = None
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            id_type = ids.type
            if batch.num_rows == 0:
                continue
            block = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            rough = (block**2).sum(1)[:, None] + (matrix**2).sum(1)[None, :] - 2.0 * block @ matrix.T
            for j in range(len(names)):
                column = rough[:, j]
                cut = bound[j]
                if len(column) > k:
                    cut = min(cut, np.partition(column, k - 1)[k - 1])
                near = np.flatnonzero(column <= cut + 1e-6 * (1.0 + abs(cut))) if np.isfinite(cut) else np.arange(len(column))
                exact = ((block[near] - matrix[j]) ** 2).sum(1)
                exact = exact if digits is None else np.round(exact, digits)
                if len(near) > k:
                    # of very many equal distances only the k least ids can stay
                    last = np.partition(exact, k - 1)[k - 1]
                    tied = near[exact == last]
                    tied = tied[pc.sort_indices(ids.take(pa.array(tied))).to_numpy()[:k]] if len(tied) > k else tied
                    exact, near = np.r_[exact[exact < last], np.full(len(tied), last)], np.r_[near[exact < last], tied]
                best[j].extend((d, ids[int(i)].as_py()) for i, d in zip(near, exact))
                best[j].sort()
                del best[j][k:]
                if len(best[j]) == k:
                    bound[j] = best[j][-1][0]
        if id_type is not None:
            flat = [(names[j], i, d) for j in range(len(names)) for d, i in best[j]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in flat], type=query_type),
                    pa.array([f[1] for f in flat], type=id_type),
                    pa.array([f[2] for f in flat], type=pa.float64()),
                ],
                names=["query_id", "id", "distance"],
            )

    return run


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame | Sequence[tuple],
    k: int = 10,
    id_col: str = "id",
    vector_col: str = "embedding",
    min_similarity: float | None = None,
    offset: int = 0,
    digits: int | None = None,
) -> DataFrame:
    """Exact k nearest rows of every query: (query_id, rank, id, distance, similarity).

    With `digits` distances are rounded before they are compared, so rows that differ by rounding errors tie.

    `queries` holds (query_id, vector). Each partition is scanned once per pass with block
    arithmetic and passes on at most k rows per query; ties are broken by id. Filter `vectors`
    before the call to search a part of it. A query meets the vectors of its own length; a vector that no query's length
    fits is an error, a null one takes no part.
    """
    passes = [p for p in _query_passes(queries) if p]
    id_type = vectors.schema[id_col].dataType
    if not passes:
        query_type = T.StringType()
    elif isinstance(queries, DataFrame):
        query_type = queries.schema["query_id"].dataType
    else:
        query_type = T.LongType() if isinstance(passes[0][0][0], int) else T.StringType()
    schema = T.StructType(
        [T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())]
    )
    spark = vectors.sparkSession
    if not passes:
        empty = spark.createDataFrame([], schema)
        return empty.select("query_id", F.lit(0).alias("rank"), "id", "distance", similarity(F.col("distance")).alias("similarity"))
    arrow_type = pa.int64() if isinstance(query_type, T.LongType) else pa.int32() if isinstance(query_type, T.IntegerType) else pa.string()
    found = None
    size = F.size(vector_col)
    dims = sorted({len(v) for rows in passes for _, v in rows})
    odd = F.raise_error(F.concat(F.lit(f"no query has as many components as a vector: not in {dims}: "), size.cast("string")))
    usable = vectors.where(F.col(vector_col).isNotNull())
    for rows, dim in [([r for r in rows if len(r[1]) == dim], dim) for rows in passes for dim in dims]:
        if not rows:
            continue
        source = usable.where(F.when(size.isin(dims), size == dim).otherwise(odd.cast("boolean"))).select(
            F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")
        )
        part = source.mapInArrow(_nearest_in_partition(rows, k + offset, arrow_type, digits), schema)
        found = part if found is None else found.unionByName(part)
    ranked = top_per(found, ["query_id"], [F.col("distance"), F.col("id")], k + offset, "rank")
    out = ranked.where(F.col("rank") > offset).withColumn("similarity", similarity(F.col("distance")))
    if min_similarity is not None:
        out = out.where(F.col("similarity") >= min_similarity)
    return out.select("query_id", "rank", "id", "distance", "similarity")


def vector_ann(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding",
    cells: int | None = None, probes: int | None = None,
) -> DataFrame:
    """Approximate k nearest by an index made for this call in the shared folder; keep one with `vector_index` to search again.

    queries(query_id, vector). Use vector_topk for exact answers; the recall is the caller's to check.
    """
    path = shared_folder(vectors.sparkSession, "vector-index")
    vector_index.build_index(vectors, path, id_col, vector_col, cells)
    return vector_index.search_index(vectors.sparkSession, path, queries, k, probes)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits each query's approximate hits contain."""
    hit = approximate.select("query_id", "id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(
        (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )


def hash_embed(df: DataFrame, text_col: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """Deterministic vectors of word counts by bucket (the first 32 bits of the word's MD5, modulo `dim`), scaled to length one.

    A text without words has the zero vector.
    """
    from colloquy.operators.matching import tokens

    @F.arrow_udf("array<float>")
    def counted(buckets: pa.Array) -> pa.Array:
        # slices of bounded size, counted at once: no object for each row
        made = []
        for at in range(0, len(buckets), 1_000):
            part = buckets.slice(at, 1_000)
            owner, own = pc.list_parent_indices(part).to_numpy(), pc.list_flatten(part).to_numpy()
            counts = np.bincount(owner * dim + own, minlength=len(part) * dim).astype(np.float64).reshape(-1, dim)
            made.append((counts / np.maximum(np.sqrt((counts**2).sum(1)), 1e-300)[:, None]).astype(np.float32).ravel())
        values = pa.array(np.concatenate(made) if made else np.zeros(0, np.float32))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * dim), values)

    number = F.transform(tokens(F.col(text_col)), lambda w: F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("bigint"))
    return df.withColumn(out, counted(F.transform(number, lambda n: F.pmod(n, F.lit(dim)).cast("int"))))


def semantic_topk(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", text_col: str = "text",
    encoder: Callable[[DataFrame, str], DataFrame] = hash_embed,
) -> DataFrame:
    """The k rows of `df` whose texts are nearest to each query's text: (query_id, rank, id, similarity).

    `queries` holds (query_id, query). `encoder` adds a column `embedding` to a table for one of its text columns; texts and
    queries pass through the same one. Distances are compared to nine places, so that equal texts are ranked by id.
    """
    vectors = encoder(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "embedding")
    asked = encoder(queries.select("query_id", "query"), "query").select("query_id", F.col("embedding").alias("vector"))
    return vector_topk(vectors, asked, k, digits=9).select("query_id", "rank", "id", "similarity")


def encode(df: DataFrame, text_col: str, embed_batch: Callable[[list[str]], list[list[float]]], out: str = "embedding", batch: int = 50) -> DataFrame:
    """Vectors from the caller's encoder, called on small lists of texts inside the tasks."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames):
        for frame in frames:
            texts = frame[text_col].fillna("").tolist()
            made: list = []
            for i in range(0, len(texts), batch):
                made.extend(embed_batch(texts[i : i + batch]))
            yield frame.assign(**{out: [list(map(float, v)) for v in made]})

    return df.mapInPandas(run, schema)


def in_pieces(df: DataFrame, text_col: str, chars: int) -> DataFrame:
    """A row for each `chars` characters of the text, with its number `piece` from 0."""
    last = F.greatest(F.ceil(F.length(text_col) / chars) - 1, F.lit(0)).cast("int")
    rows = df.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn(text_col, F.substring(text_col, F.col("piece") * chars + 1, F.lit(chars)))


def embed_pending(messages: DataFrame, existing: DataFrame, piece_chars: int = 8000, min_chars: int = 10) -> DataFrame:
    """User messages still to be embedded: one per id, no noise, long enough, not in `existing`; long ones in pieces."""
    rows = messages.where("role = 'user'").where(~noise.is_noise(F.col("content")))
    rows = rows.join(existing.select("message_id").distinct(), "message_id", "left_anti")
    order = [F.col("created"), F.col("conversation_id"), F.col("content")]
    single = top_per(rows, ["message_id"], order, 1)
    whole = single.where(F.length("content") >= min_chars)
    return in_pieces(whole, "content", piece_chars).select(
        "message_id", "piece", "conversation_id", "conversation_title", "content", "role", "year", "month",
    )


def summary_texts(s: DataFrame, piece_chars: int = 2000, min_chars: int = 10) -> DataFrame:
    """Usable texts of summaries to embed, long ones in pieces."""
    texts = s.where(F.length("embedding_text") > min_chars).select("conversation_id", F.col("embedding_text").alias("text"))
    return in_pieces(texts, "text", piece_chars)


def dim_check(vectors: DataFrame, expected: int, vector_col: str = "embedding") -> DataFrame:
    """Stored dimensions against the encoder's; `ok` also for an empty table."""
    return vectors.agg(
        F.min(F.size(vector_col)).alias("min_dim"),
        F.max(F.size(vector_col)).alias("max_dim"),
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.size(vector_col) != expected).alias("mismatched"),
    ).withColumn("ok", F.col("mismatched") == 0)


def vector_stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return vectors.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("dim"))


def write_vectors(vectors: DataFrame, path: str, full: bool = False) -> None:
    """Create, rebuild (full) or append to the vector table."""
    vectors.write.mode("overwrite" if full else "append").parquet(path)
