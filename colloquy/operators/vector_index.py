"""A stored index for approximate vector search: cells, residual product codes, exact re-ranking.

Coarse k-means cells split the vectors; inside a cell a vector's residual is kept as one byte for each slice of its
components (the nearest of 256 learned points). A search looks into the `probes` cells nearest to the query only, ranks their
vectors by the codes, and gives the best of these their exact distances.

    <path>/model          centres and code points, one row
    <path>/cells/cell=C   blocks of at most BLOCK vectors: ids, codes, vectors; one row for each block

Cells are partitions, so a search reads those that its queries probe. Centres and code points are learned from a sample of
bounded size (the vectors of the least hashes); all vectors are indexed. New vectors are added to the cells they fall into.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ranking import top_per

#: Vectors that the model is learned from, at most; cells, at most.
SAMPLE, MOST_CELLS = 32_768, 4_096
#: Code points of a slice; components in a slice.
POINTS, SLICE = 256, 4
BLOCK, QUERY_BLOCK = 4_096, 256
ROUNDS, SEED = 12, 5
MODEL = "cells int, dim int, slices int, points int, centres binary, codebooks binary, id_type string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Number of the nearest point of each row; ties go to the first."""
    out = np.empty(len(rows), np.int64)
    norms = (points ** 2).sum(axis=1)
    for at in range(0, len(rows), 8_192):
        part = rows[at:at + 8_192]
        out[at:at + len(part)] = (norms[None, :] - 2.0 * part @ points.T).argmin(axis=1)
    return out


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn at random; a centre that loses all rows takes the place of a random one."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(rows, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        lost = count == 0
        centres = sums / np.maximum(count, 1)[:, None]
        if lost.any():
            centres[lost] = rows[rng.choice(len(rows), int(lost.sum()))]
    return centres


class Model:
    """Cell centres, and for each slice of components the points that residuals are coded by."""

    def __init__(self, centres: np.ndarray, codebooks: np.ndarray):
        self.centres, self.codebooks = centres, codebooks
        self.dim, (self.slices, self.points, self.width) = centres.shape[1], codebooks.shape

    @staticmethod
    def learn(sample: np.ndarray, cells: int) -> Model:
        if not len(sample):
            return Model(np.zeros((0, 0)), np.zeros((0, 0, SLICE)))
        centres = k_means(sample, cells)
        rest = Model._sliced(sample - centres[_nearest(sample, centres)])
        return Model(centres, np.stack([k_means(part, POINTS, seed=SEED + i) for i, part in enumerate(rest)]))

    @staticmethod
    def _sliced(rows: np.ndarray) -> list[np.ndarray]:
        """Components in slices of SLICE, the last filled up with zeros."""
        room = -rows.shape[1] % SLICE
        wide = np.pad(rows, ((0, 0), (0, room)))
        return [wide[:, i:i + SLICE] for i in range(0, wide.shape[1], SLICE)]

    def cells_of(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows, self.centres)

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(part, book) for part, book in zip(self._sliced(rows - self.centres[cells]), self.codebooks)], axis=1).astype(np.uint8)

    def probed(self, query: np.ndarray, probes: int) -> np.ndarray:
        apart = ((self.centres - query) ** 2).sum(axis=1)
        return np.argsort(apart, kind="stable")[:probes]

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """(queries, slices, points): squared distance from each query's residual in the cell to each code point."""
        parts = self._sliced(queries - self.centres[cell])
        return np.stack([((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2) for part, book in zip(parts, self.codebooks)], axis=1)

    def row(self) -> tuple:
        return len(self.centres), self.dim, self.slices, self.points, self.centres.tobytes(), self.codebooks.tobytes()


def load_model(spark: SparkSession, path: str) -> tuple[Model, str]:
    """The model at `path`, and the type of the ids."""
    r = spark.read.schema(MODEL).parquet(f"{path}/model").first()
    centres = np.frombuffer(r["centres"]).reshape(r["cells"], r["dim"])
    return Model(centres, np.frombuffer(r["codebooks"]).reshape(r["slices"], r["points"], SLICE)), r["id_type"]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows with an id and a vector without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.when(~F.coalesce(odd, F.lit(True)) & (F.size(v) > 0), v).alias("v")).where("id is not null and v is not null")


def _cells_schema(id_type: str) -> str:
    return f"ids array<{id_type}>, codes binary, vectors binary, n int, cell int"


def build_index(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None) -> None:
    """Learn a model from a sample of at most SAMPLE vectors, and index all of `vectors` at `path`, which is made anew.

    `cells` defaults to the square root of their number, MOST_CELLS at most. Rows without an id, and vectors that are null,
    empty or not finite, are left out; vectors of another length than the sample's are an error. Repeated ids are rows of
    their own. An index of no vectors has no cells: nothing is found in it, and nothing can be added.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1) if n else np.zeros((0, 0))
    model = Model.learn(sample, cells or max(1, min(MOST_CELLS, round(n ** 0.5))))
    row = (*model.row(), rows.schema["id"].dataType.simpleString())
    spark.createDataFrame([row], MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    _write(rows, model, path, "overwrite")


def add_to_index(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Index more vectors by the model that is there. Build anew when the data have changed much."""
    _write(_usable(vectors, id_col, vector_col), load_model(vectors.sparkSession, path)[0], path, "append")


def _write(rows: DataFrame, model: Model, path: str, mode: str) -> None:
    id_type = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((model.centres, model.codebooks))  # at most 4,096 centres
    dim, build = model.dim, Model

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = build(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            if (lengths != dim).any():
                raise ValueError(f"a vector of {lengths[lengths != dim][0]} components in an index of {dim}")
            matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cells = own.cells_of(matrix)
            codes = own.codes(matrix, cells)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in matrix], pa.binary()), pa.array(cells, pa.int32())],
                ["id", "code", "vector", "cell"])

    coded = rows.mapInArrow(code, f"id {id_type}, code binary, vector binary, cell int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, codes, parts = None, [], [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(kind)), pa.array([b"".join(codes)], pa.binary()), pa.array([b"".join(parts)], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([cell], pa.int32())],
                ["ids", "codes", "vectors", "n", "cell"])

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for key, *values in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "code", "vector"))):
                if ids and (key != cell or len(ids) == BLOCK):
                    yield block()
                    ids, codes, parts = [], [], []
                cell = key
                ids.append(values[0])
                codes.append(values[1])
                parts.append(values[2])
        if ids:
            yield block()

    # ranges, not hashes: a cell that holds a large part of all vectors is spread over several tasks and files
    spread = F.xxhash64("id")
    dealt = coded.repartitionByRange("cell", spread).sortWithinPartitions("cell", spread)
    dealt.mapInArrow(pack, _cells_schema(id_type)).write.mode(mode).partitionBy("cell").parquet(f"{path}/cells")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, keep: int | None = None) -> DataFrame:
    """About the k nearest rows of every query: (query_id, rank, id, distance, similarity), distances exact.

    `queries` holds (query_id, vector). `probes` cells are looked into (a quarter of them by default, 16 at least); in each
    block the `keep` vectors (10k by default, 100 at least) best by code get exact distances. Queries are dealt in blocks to
    the cells they probe, and only these cells are read; their numbers, one for each cell at most, pass through the driver.
    A query whose vector is null finds nothing, one of another length is an error.
    """
    model, id_type = load_model(spark, path)
    cells = len(model.centres)
    probes, keep = probes or max(16, -(-cells // 4)), keep or max(100, 10 * k)
    shared = spark.sparkContext.broadcast((model.centres, model.codebooks))
    query_type, dim, build = queries.schema["query_id"].dataType.simpleString(), model.dim, Model
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v")).where("v is not null")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = build(*shared.value)
        for batch in batches:
            found = []
            for i, vector in enumerate(batch.column("v").to_pylist()):
                if cells and len(vector) != dim:
                    raise ValueError(f"a query of {len(vector)} components for an index of {dim}")
                raw = np.array(vector).tobytes()
                found += [(i, raw, int(c)) for c in (own.probed(np.array(vector), probes) if cells else ())]
            if found:
                index, raws, numbers = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(index)), pa.array(raws, pa.binary()), pa.array(numbers, pa.int32())], ["query_id", "vector", "cell"])

    probed = asked.mapInArrow(probe, f"query_id {query_type}, vector binary, cell int")
    # the queries of a cell in blocks of about QUERY_BLOCK
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = probed.withColumn("part", F.pmod(F.xxhash64("query_id", "vector"), F.lit(parts)))
    blocks = dealt.groupBy("cell", "part").agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("vector").alias("q")).drop("part")
    wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]
    stored = spark.read.schema(_cells_schema(id_type)).parquet(f"{path}/cells").where(F.col("cell").isin(wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = build(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                cell, n = batch.column("cell")[i].as_py(), batch.column("n")[i].as_py()
                ids = batch.column("ids")[i].values
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(n, -1)
                vectors = np.frombuffer(batch.column("vectors")[i].as_py()).reshape(n, -1)
                query_ids = batch.column("query_ids")[i].values
                matrix = np.stack([np.frombuffer(x) for x in batch.column("q")[i].as_py()])
                who, which, far = [], [], []
                for j, table in enumerate(own.tables(matrix, cell)):
                    near = np.arange(n)
                    if n > keep:
                        rough = table[np.arange(own.slices)[None, :], codes].sum(axis=1)
                        near = np.flatnonzero(rough <= np.partition(rough, keep - 1)[keep - 1])  # ties of the last one too
                    exact = ((vectors[near] - matrix[j]) ** 2).sum(axis=1)
                    if len(near) > k:
                        stay = np.flatnonzero(exact <= np.partition(exact, k - 1)[k - 1])
                        stay = np.array(sorted(stay, key=lambda x: (exact[x], ids[int(near[x])].as_py()))[:k])
                        near, exact = near[stay], exact[stay]
                    who.append(np.full(len(near), j))
                    which.append(near)
                    far.append(exact)
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(np.concatenate(who))), ids.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(far), pa.float64())], ["query_id", "id", "distance"])

    pairs = stored.join(blocks, "cell").select("cell", "n", "ids", "codes", "vectors", "query_ids", "q")
    found = pairs.mapInArrow(search, f"query_id {query_type}, id {id_type}, distance double")
    ranked = top_per(found, ["query_id"], [F.col("distance"), F.col("id")], k, "rank")
    return ranked.select("query_id", "rank", "id", "distance", (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("similarity"))
