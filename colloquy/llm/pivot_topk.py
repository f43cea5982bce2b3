"""Exact top-k search by pivot-table elimination.

Every vector's distances to the pivots are computed once. For a query q and a candidate x, no pivot p allows a distance
below |d(q,p) - d(x,p)|; the largest of these bounds gives the highest inner product x can have. Candidates are taken in the
order of that bound until the next one cannot enter the query's k best. What the first block of candidates gives bounds the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import pick, staged

K = 5
SCALE = 256
PIVOTS = 32
#: Vectors among which pivots are chosen: those with the least hash of their id. The choice affects speed only.
SAMPLE = 2_048
CANDIDATES, QUERIES = 8_192, 512
#: Candidates of a query that are scored at once.
STEP = 256
MOST_LENGTHS = 1_000
BLOCK = ("ids", "rows", "matrix", "pivots")
MET = "key int, q_ids binary, q_rows binary, q_matrix binary, q_pivots binary, q_floor binary, found binary"
PACKED = "part int, block bigint, ids binary, rows binary, matrix binary, pivots binary"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale x), component by component, as integers; null where the vector or a component is null or not finite."""
    wide = vector.cast("array<double>")
    infinite = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(infinite, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots: each the sampled vector farthest from those before it."""
    if not len(sample):
        return sample.reshape(0, sample.shape[1] if sample.ndim > 1 else 0)
    chosen, apart = [sample[0]], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and apart.max() > 0:
        chosen.append(sample[int(apart.argmax())])
        apart = np.minimum(apart, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _packed(vectors: DataFrame, rows: int, pivots: np.ndarray) -> DataFrame:
    """Blocks of at most `rows` vectors with their distances to the pivots, as raw arrays; a row for each block."""
    width = pivots.shape[1]

    def distances(matrix: np.ndarray) -> np.ndarray:
        squares = (matrix ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * (matrix @ pivots.T)
        return np.sqrt(np.maximum(squares, 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, parts, waiting, block = [], [], [], 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, places, parts, waiting, block
            every, place, matrix = np.concatenate(ids), np.concatenate(places), np.concatenate(parts)
            for at in range(0, len(every), rows):
                if not last and len(every) - at < rows:
                    ids, places, parts, waiting = [every[at:]], [place[at:]], [matrix[at:]], len(every) - at
                    return
                own = matrix[at:at + rows]
                block += 1
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "block": pa.array([block], pa.int64()), "ids": [every[at:at + rows].tobytes()], "rows": [place[at:at + rows].tobytes()],
                    "matrix": [own.tobytes()], "pivots": [distances(own).tobytes()]})
            ids, places, parts, waiting = [], [], [], 0

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64))
                places.append(batch.column("row").to_numpy(zero_copy_only=False))
                parts.append(batch.column("vector").flatten().to_numpy().astype(np.float64).reshape(-1, width))
                waiting += batch.num_rows
            if waiting >= rows:
                yield from flush(False)
        if waiting:
            yield from flush(True)

    return vectors.mapInArrow(pack, PACKED)


def _block_topk(query: dict, other: dict, width: int, k: int) -> tuple[list[np.ndarray], int]:
    """(query rows, query ids, candidate ids, scores) of each query's k best in one block of candidates, and how many were scored.

    Where the query block brings floors (scores that k candidates elsewhere reach), candidates whose bound is below are left out.
    """
    q_ids, ids, q_rows, rows = (np.frombuffer(b[name], np.int64) for name in ("ids", "rows") for b in (query, other))
    q, x = (np.frombuffer(b["matrix"]).reshape(-1, width) for b in (query, other))
    q_far, x_far = (np.frombuffer(b["pivots"]).reshape(len(m), -1) for b, m in ((query, q), (other, x)))
    q_norm, x_norm = (q ** 2).sum(axis=1), (x ** 2).sum(axis=1)
    floors = np.frombuffer(query["floor"]) if query.get("floor") else np.full(len(q), -np.inf)
    found, scored = [], 0
    by_id = np.argsort(ids, kind="stable")
    x, x_far, x_norm, ids, rows = x[by_id], np.ascontiguousarray(x_far[by_id].T), x_norm[by_id], ids[by_id], rows[by_id]
    for row in range(len(q)):
        apart = np.zeros(len(x))
        for p in range(len(x_far)):
            np.maximum(apart, np.abs(x_far[p] - q_far[row, p]), out=apart)
        apart = np.maximum(apart - 1e-6 * (1 + apart), 0)  # distances are rounded; bounds stay on the safe side
        bound = np.floor((q_norm[row] + x_norm - apart ** 2) / 2 + 1e-6)
        start, best = 0, (np.zeros(0, np.int64), np.zeros(0))
        left = np.flatnonzero(bound >= floors[row])
        first = np.argpartition(-bound[left], 4 * STEP)[:4 * STEP] if len(left) > 4 * STEP else np.arange(len(left))
        top = left[first[np.argsort(-bound[left[first]], kind="stable")]]
        complete = len(top) == len(left)
        while True:
            if start >= len(top):
                if complete:
                    break
                rest = np.delete(left, first)
                top, start, complete = rest[np.argsort(-bound[rest], kind="stable")], 0, True
                continue
            if len(best[0]) == k and bound[top[start]] < best[1][-1]:
                break
            some = top[start:start + STEP]
            start += STEP
            some = some[rows[some] != q_rows[row]]
            scored += len(some)
            every, scores = np.r_[best[0], ids[some]], np.r_[best[1], x[some] @ q[row]]
            keep = np.lexsort((every, -scores))[:k]
            best = every[keep], scores[keep]
        found.append((np.full(len(best[0]), q_rows[row]), np.full(len(best[0]), q_ids[row]), *best))
    return [np.concatenate(c) for c in zip(*found)], scored


def _floors(rows: bytes, found: list[np.ndarray], k: int) -> bytes:
    """The k-th score found for each row of a query block, minus infinity where fewer were found."""
    floors, rows = np.full(len(rows) // 8, -np.inf), np.frombuffer(rows, np.int64)
    order = np.argsort(rows, kind="stable")
    place = order[np.searchsorted(rows[order], found[0])]
    full = np.bincount(place, minlength=len(floors)) == k
    least = np.full(len(floors), np.inf)
    np.minimum.at(least, place, found[3])
    return np.where(full, least, floors).tobytes()


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, n_pivots: int = PIVOTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's `k` highest integer inner products among all other rows.

    `is_query` is a condition on `vec_id`. Ties go to the smaller vec_id; a query has fewer rows if there are fewer
    candidates. Repeated ids are rows of their own: each is a candidate, also for the others, and each query row has its own
    `k` results. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
    id. Vectors of different lengths are searched apart; more than MOST_LENGTHS lengths are an error. An empty table gives
    no rows. Scores are exact below 2^53.

    Blocks of queries meet blocks of candidates (queries x rows / (512 x 8192) pairs of blocks, each block one row); a
    pair leaves k rows for each query. Each query block meets one block of candidates first; the k-th scores found there
    are floors, written with the block, for the bounds of all others.
    """
    spark = vectors.sparkSession
    usable = pick(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("vector"))
    usable = staged(usable.where("vec_id is not null and size(vector) > 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
    parts = []
    widths = usable.select(F.size("vector")).distinct().limit(MOST_LENGTHS + 1).collect()
    if len(widths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    for (width,) in sorted(widths):
        own = usable.where(F.size("vector") == width)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector")
        pivots = choose_pivots(sample.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width), n_pivots)
        n = own.count()
        groups = max(1, -(-n // CANDIDATES))
        dealt = own.withColumn("group", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(groups)))
        candidates = staged(_packed(dealt.repartition(groups, "group").select("vec_id", "row", "vector"), CANDIDATES, pivots), "candidates")
        queries = staged(_packed(own.where(is_query).select("vec_id", "row", "vector"), QUERIES, pivots), "queries")
        order = Window.orderBy("part", "block")
        numbers = staged(candidates.select("part", "block", (F.row_number().over(order) - 1).alias("key")), "numbers")
        blocks = numbers.count()
        # Their number is fixed, so that few blocks share a task and none are put together later.
        keyed = candidates.join(numbers, ["part", "block"]).repartition(4 * blocks, "key").select("key", *BLOCK)

        def meet(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    query, other = ({c: row[p + c] for c in BLOCK} for p in ("q_", ""))
                    query["floor"] = row["q_floor"]
                    columns, _ = _block_topk(query, other, width, k)
                    yield pa.RecordBatch.from_pydict({"key": pa.array([row["key"]], pa.int32()), **{
                        f"q_{c}": pa.array([query[c]], pa.binary()) for c in BLOCK}, "q_floor": [_floors(query["rows"], columns, k)],
                        "found": [np.stack([c.astype(np.int64) for c in columns]).tobytes()]})

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in batch.column("found").to_pylist():
                    columns = np.frombuffer(found, np.int64).reshape(4, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "score"])

        asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in BLOCK])
        start = asked.withColumn("key", F.pmod(F.xxhash64("q_ids"), F.lit(blocks)).cast("int")).withColumn("q_floor", F.lit(None).cast("binary"))
        met = staged(keyed.join(start.repartition(4 * blocks, "key"), "key").mapInArrow(meet, MET), "met")
        others = F.array_except(F.sequence(F.lit(0), F.lit(blocks - 1)), F.array("key"))
        rest = met.withColumn("key", F.explode(others)).drop("found").repartition(4 * blocks, "key")
        parts += [part.select("found").mapInArrow(unpack, schema) for part in (met, keyed.join(rest, "key").mapInArrow(meet, MET))]
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
