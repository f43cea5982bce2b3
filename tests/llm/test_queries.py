"""The registered queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import exact_dedup, mixing, near_dedup, oracle, queries, secrets
from tests.llm import samples
from tests.llm.test_text_operators import SECRET_TEXTS
from tools.compare import TABLES, rows_of

DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"op2_token_files", "op3_sharding", "op6_token_counts", "op7_language", "op9_mixing", "op10_packing"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ROWS_ONLY:
        return
    cur = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_secrets_sql_on_awkward_texts(spark, con):
    docs = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id bigint, text string")
    df = secrets.scan(docs).drop("secrets")
    own = duckdb.connect()
    own.register("documents", pa.table({"doc_id": list(range(len(SECRET_TEXTS))), "text": pa.array(SECRET_TEXTS, pa.string())}))
    cur = own.execute(oracle.oracle_sql()["op1_secrets"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_pipeline_stages(spark):
    docs = samples.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        before, after = (Counter((r[0], r[1], *r[5:]) for r in x.collect()) for x in (docs, out))
        if name == "language identification":
            assert after == Counter({k: n for k, n in before.items() if k[1] and any(c.isalpha() for c in k[1])})
        elif name == "exact deduplication":
            assert sum(after.values()) == exact_dedup.dedup(docs).where("kept").count() and after <= before and max(after.values()) == 1
        elif name == "near deduplication":
            assert sum(after.values()) == near_dedup.near_duplicates(docs).where("kept").count() and after <= before
        else:
            plain = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
            assert plain.select(mixing.size_of(F.col("c1")).alias("n")).agg({"n": "sum"}).first()[0] == mixing.mix(docs).agg({"taken": "sum"}).first()[0]
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_on_an_empty_table(spark):
    docs = samples.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, DIR)
        assert docs_out.collect() == []
