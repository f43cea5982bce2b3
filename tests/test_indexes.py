"""The stored vector and full-text indexes against exact answers, and how little of them a search reads."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import fulltext, text_index, vector, vector_index


def scanned_partitions(df, column):
    """What the plan's partition filters say of `column`."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "PartitionFilters" in line and f"{column}#" in line]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    middles = rng.normal(0, 3, (25, 10))
    vecs = [(i, (middles[i % 25] + rng.normal(0, 1, 10)).astype(np.float32).tolist()) for i in range(3000)]
    hot = [(10_000 + i, vecs[0][1]) for i in range(6000)]  # one vector that two thirds of the rows hold
    odd = [(20_000, None), (20_001, []), (20_002, [float("nan")] * 10), (20_003, [None] + [0.0] * 9), (None, [0.0] * 10), (5, vecs[5][1])]
    queries = [(f"q{i}", (middles[i] + rng.normal(0, 0.5, 10)).tolist()) for i in range(25)] + [("none", None)]
    return vecs, hot, odd, queries


def frames(spark, cloud, rows):
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5), spark.createDataFrame(cloud[3], "query_id string, vector array<double>")


def test_vector_index_recall_and_growth(spark, cloud, tmp_path):
    vecs, hot, odd, _ = cloud
    first, queries = frames(spark, cloud, vecs[:2000] + odd)
    path = str(tmp_path / "index")
    vector_index.build_index(first, path)
    vector_index.add_to_index(frames(spark, cloud, vecs[2000:])[0], path)
    every = frames(spark, cloud, vecs + [odd[-1]])[0]
    exact = vector.vector_topk(every, queries.where("vector is not null"), 10)
    some = vector_index.search_index(spark, path, queries, 10)
    recalls = [r.recall for r in vector.recall(exact, some).collect()]
    assert len(recalls) == 25 and min(recalls) >= 0.8 and sum(recalls) / 25 >= 0.95
    # every cell probed and every vector kept: the exact answer, ties by id, repeated ids as rows of their own
    whole = vector_index.search_index(spark, path, queries, 10, probes=10_000, keep=10_000)
    assert [(r.query_id, r["rank"], r.id) for r in whole.orderBy("query_id", "rank").collect()] == [
        (r.query_id, r["rank"], r.id) for r in exact.orderBy("query_id", "rank").collect()]


def test_a_search_reads_the_probed_cells_only(spark, cloud, tmp_path):
    vecs, hot, _, _ = cloud
    rows, queries = frames(spark, cloud, vecs + hot)
    path = str(tmp_path / "index")
    vector_index.build_index(rows, path, cells=30)
    one = queries.where("query_id = 'q3'")
    found = vector_index.search_index(spark, path, one, 5, probes=2)
    wanted = sorted(vector_index.load_model(spark, path)[0].probed(np.array(cloud[3][3][1]), 2).tolist())
    [line] = scanned_partitions(found, "cell")
    assert found.count() == 5 and sorted(int(c) for c in re.search(r"cell#\d+ IN \(([\d,]+)\)", line)[1].split(",")) == wanted
    blocks = spark.read.parquet(f"{path}/cells")
    assert blocks.agg(F.max("n")).first()[0] <= vector_index.BLOCK and blocks.agg(F.sum("n")).first()[0] == 9000
    near = vector_index.search_index(spark, path, spark.createDataFrame([("h", vecs[0][1])], "query_id string, vector array<double>"), 5, probes=3)
    assert [r.id for r in near.orderBy("rank").collect()] == [0, 10_000, 10_001, 10_002, 10_003]


def test_vector_index_of_nothing_and_of_other_lengths(spark, cloud, tmp_path):
    path, (rows, queries) = str(tmp_path / "index"), frames(spark, cloud, cloud[0][:50])
    vector_index.build_index(rows.limit(0), path)
    assert vector_index.search_index(spark, path, queries, 3).collect() == []
    vector_index.build_index(rows, path)
    with pytest.raises(Exception, match="components"):
        vector_index.add_to_index(spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, embedding array<float>"), path)
    with pytest.raises(Exception, match="components"):
        vector_index.search_index(spark, path, spark.createDataFrame([("a", [1.0])], "query_id string, vector array<double>")).collect()


WORDS = ["the", "of", "and", "data", "spark", "été", "x1", *[f"w{i}" for i in range(300)]]


def made_up(n, seed):
    rng = random.Random(seed)
    return [(f"d{i:04d}", " ".join(rng.choices(WORDS, weights=[600, 300, 200, 40, 20, 10, 5, *[1] * 300], k=rng.randrange(60)))) for i in range(n)]


QUERIES = [("a", "the"), ("b", "spark data"), ("c", "the of w7 w8"), ("d", "nothing here"), ("e", "Été, x1!"), ("f", ""), ("g", "w1 w2 w3 w4 w5 the")]


@pytest.mark.parametrize("block", [1024, 8])
def test_text_index_equals_bm25(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK", block)
    rows = made_up(700, 1) + [("d0003", "spark again"), ("empty", ""), ("null", None)]
    path = str(tmp_path / "index")
    as_frame = lambda some: spark.createDataFrame(some, "id string, text string").repartition(4)
    old = [r for r in rows if r[0] < "d0400"]
    text_index.build_text_index(as_frame(old), path)
    text_index.add_to_text_index(as_frame([r for r in rows if r not in old] + [("d0001", "an id that is there stays as it is")]), path)
    table = spark.createDataFrame(QUERIES, "query_id string, query string")
    for k in (3, 10, 1000):
        want = [tuple(r) for r in fulltext.bm25(as_frame(rows), QUERIES, k).orderBy("query_id", "rank").collect()]
        for queries in (QUERIES, table):
            got = [tuple(r) for r in text_index.search_text_index(spark, path, queries, k).orderBy("query_id", "rank").collect()]
            assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)


def test_a_text_search_stops_early_and_reads_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    path = str(tmp_path / "index")
    text_index.build_text_index(spark.createDataFrame(made_up(3000, 2), "id string, text string"), path, buckets=40)
    blocks, mean = text_index._asked_blocks(spark, path, [("a", "the"), ("b", "spark")])
    kept, judged = text_index._needed(blocks, mean, 5)
    assert kept.count() < 0.2 * judged.count()
    found = text_index.search_text_index(spark, path, [("a", "the")], 5)
    assert scanned_partitions(found, "bucket") and found.count() == 5
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.agg(F.max("n")).first()[0] <= 16 and stored.select("bucket").distinct().count() == 40


def test_text_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.build_text_index(spark.createDataFrame([], "id string, text string"), path)
    assert text_index.search_text_index(spark, path, QUERIES).collect() == []


def test_equal_distances_keep_the_least_ids():
    """Of a batch of equal vectors only k ids become Python objects."""
    import numpy as np
    import pyarrow as pa

    from colloquy.operators import vector

    class Ids:
        """Counts the ids that are taken out one by one."""

        def __init__(self, values):
            self.values, self.type, self.taken = pa.array(values), pa.int64(), 0

        def take(self, at):
            return self.values.take(at)

        def __getitem__(self, i):
            self.taken += 1
            return self.values[i]

    class Batch:
        num_rows = 5000

        def __init__(self):
            self.ids = Ids(list(range(5000, 0, -1)))

        def column(self, i):
            return self.ids if i == 0 else pa.array([[1.0, 0.0]] * 5000)

    batch = Batch()
    out = next(vector._nearest_in_partition([("q", [0.0, 0.0])], 3, pa.string())(iter([batch])))
    assert out.column("id").to_pylist() == [1, 2, 3] and batch.ids.taken == 3


def test_hashed_vectors_are_made_without_pandas(spark):
    from colloquy.operators import vector

    rows = spark.createDataFrame([(0, "a b a"), (1, None), (2, ""), (3, "c")], "id int, text string")
    made = vector.hash_embed(rows, "text", dim=8)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["embedding"] for r in made.collect()}
    assert got[1] == got[2] == [0.0] * 8 and sorted(got[3])[-2:] == [0.0, 1.0]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6


def test_known_ids_are_told_apart_without_their_texts(spark, tmp_path, monkeypatch):
    """An index reads each text once, and packs a long term's postings into full blocks over several batches."""
    from colloquy.operators import text_index

    monkeypatch.setattr(text_index, "BLOCK", 4)
    docs = spark.createDataFrame([(i, "same word" + " same" * (i % 3)) for i in range(30)] + [(3, "other same"), (None, "lost")], "id int, text string")
    text_index.build_text_index(docs, str(tmp_path / "index"))
    text_index.add_to_text_index(docs.union(spark.createDataFrame([(99, "new word")], "id int, text string")), str(tmp_path / "index"))
    blocks = spark.read.parquet(str(tmp_path / "index" / "postings")).collect()
    tf = {(r["term"], i): n for r in blocks for i, n in zip(r["ids"], r["tfs"])}
    assert tf["same", 3] == 2 and tf["other", 3] == 1 and tf["same", 5] == 3 and tf["word", 99] == 1 and ("lost", None) not in tf
    assert {i: r for r, i in ((n, i) for r in blocks for i, n in zip(r["ids"], r["lengths"]))}[3] == 4
    for r in blocks:
        assert len(r["ids"]) == r["n"] <= 4 and r["most"] == max(r["tfs"]) and r["least"] == min(r["lengths"])
    assert sum(r["n"] for r in blocks if r["term"] == "same") == 30
