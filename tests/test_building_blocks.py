"""Ranking, matching, percentiles and vectors against brute force, with hot keys."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import fulltext, matching, vector
from colloquy.operators.messages import reply_depths
from colloquy.operators.domain_state import domain_switches
from colloquy.operators.ranking import exact_percentile, fill_forward, in_slices, number_in_order, number_rows, top_per

rng = random.Random(7)


def test_number_rows_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i // 50, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, block int, pos int").repartition(7)
    out = number_rows(df, ["g"], ["block"], ["pos"], "n", "total").collect()
    want = {}
    for g, _, pos in sorted(rows, key=lambda r: r[2]):
        want.setdefault(g, []).append(pos)
    assert {(r.g, r.pos): (r.n, r.total) for r in out} == {
        (g, p): (i, len(ps)) for g, ps in want.items() for i, p in enumerate(ps)}


@pytest.fixture
def small_ranges(spark):
    """Ranges as cut: adaptive execution would join those of a small table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbering_where_one_second_of_one_group_holds_most_rows(spark, small_ranges):
    rows = [("hot", 5, f"{i:06}") if i % 3 else (None if i % 9 == 0 else f"g{i % 7}", i % 11, f"{i:06}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, t int, id string").repartition(7)
    sizes = [r["count"] for r in in_slices(df, ["g", "t", "id"]).groupBy("_slice").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2.5 * len(rows) / 8
    out = number_in_order(df, ["g"], ["t", "id"], "n", "total").collect()
    want = {}
    for g, t, i in sorted(rows, key=lambda r: r[1:]):
        want.setdefault(g, []).append((t, i))
    assert sorted((str(r.g), r.t, r.id, r.n, r.total) for r in out) == sorted(
        (str(g), t, i, k, len(of)) for g, of in want.items() for k, (t, i) in enumerate(of))
    assert number_in_order(df.limit(0), ["g"], ["t", "id"], "n", "total").collect() == []


def test_switches_of_a_source_with_one_hot_second(spark, small_ranges):
    moves = [("hot" if i % 4 else "other", f"{1 if i % 4 else i:05}", f"c{i:05}", f"d{rng.randrange(40)}" if i % 50 else "") for i in range(4_000)]
    df = spark.createDataFrame(moves, "source string, summarized_at string, conversation_id string, domain_primary string").repartition(6)
    want, last = set(), {}
    for source, _, _, domain in sorted(m for m in moves if m[3]):
        if last.get(source, domain) != domain:
            want.add((last[source], domain))
        last[source] = domain
    assert sorted(map(tuple, domain_switches(df).collect())) == sorted(want)


def test_fill_forward(spark):
    rows, last, want = [], {}, {}
    for i in range(600):
        g, v = f"g{rng.randrange(3)}", f"v{i}" if rng.random() < 0.05 else None
        last[g] = v or last.get(g)
        rows.append((g, i // 40, i, v))
        want[i] = last[g]
    df = spark.createDataFrame(rows, "g string, block int, pos int, v string").repartition(5)
    assert {r.pos: r.v for r in fill_forward(df, ["g"], ["block"], ["pos"], ["v"]).collect()} == want


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q):
    rows = [(f"k{i % 3}", rng.choice([rng.gauss(0, 50), 5.0, rng.random() * 1e6])) for i in range(3001)] + [("one", 4.0), ("k0", None)]
    got = {r.k: r.p for r in exact_percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", q, "p").collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == pytest.approx(np.percentile([v for key, v in rows if key == k and v is not None], q * 100), rel=1e-12)


def test_top_per_keeps_ties_in_order(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(10)], "k string, v int, id int").repartition(4)
    assert sorted(r.id for r in top_per(df, ["k"], [F.col("v"), F.col("id")], 3).collect()) == [0, 1, 2]


TEXTS = ["Python is fun", "the pythonic way 100%", "Ünïcode ÉTÉ text", "a_b and ab", "", None, "x", "next step: deploy", "état d'été"]
TERMS = ["python", "THE", "été", "a_b", "x", "ne", "next step", "zzz", "100%", "deploy"]


def pairs(df):
    return sorted((r.id, r.topic) for r in df.collect())


@pytest.fixture(params=["one slice", "many slices"])
def large_path(request, monkeypatch):
    """A table of terms in one pass over the texts, and in several."""
    if request.param == "many slices":
        monkeypatch.setattr(matching, "SLICE_CHARS", 200)


def test_terms_inline_table_and_brute_force_agree(spark, large_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    want = sorted((i, t) for i, x in enumerate(TEXTS) if x for t in TERMS if t.lower() in x.lower())
    assert pairs(matching.match_terms(df, ["text"], TERMS)) == want
    table = spark.createDataFrame([(t,) for t in TERMS], "topic string")
    assert pairs(matching.match_terms(df, ["text"], table, key="id")) == want
    assert pairs(matching.match_terms(df, ["text"], TERMS[:1])) == [w for w in want if w[1] == "python"]


def test_many_terms_over_random_texts(spark, large_path):
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, w) for i, t in enumerate(texts) for w in set(words) if w in t)
    assert pairs(matching.match_terms(df, ["text"], spark.createDataFrame([(w,) for w in words], "w string"), key="id")) == want


def test_number_of_terms_and_blank_terms_change_nothing(spark):
    df = spark.createDataFrame([(0, "term7 and term31"), (1, "nothing"), (2, "")], "id int, text string")
    for n in (32, 33, 40):
        listed = ["", None, *[f"Term{i}" for i in range(n)]]
        want = [(0, t) for t in sorted(listed[2:]) if t.lower() in "term7 and term31"]
        assert pairs(matching.match_terms(df, ["text"], listed)) == want
        table = spark.createDataFrame([(t,) for t in listed], "topic string")
        assert pairs(matching.match_terms(df, ["text"], table)) == want
    assert pairs(matching.match_terms(df, ["text"], [])) == pairs(matching.match_terms(df, ["text"], [""])) == []


def test_wildcards(spark):
    df = spark.createDataFrame([(0, "what is next step"), (1, "next what"), (2, "repo-1"), (3, "repo")], "id int, text string")
    assert pairs(matching.match_terms(df, ["text"], ["what%step", "repo-_"], wildcards=True)) == [(0, "what%step"), (2, "repo-_")]
    assert pairs(matching.match_terms(df, ["text"], ["what%step"])) == []


def test_whole_word_names(spark):
    names = ["repo-1", "repo-12", "core", "my.lib", "Core Engine"]
    texts = ["see repo-1 now", "repo-12 is new", "the CORE engine", "encore", "use my.lib!", "my-lib", "repo-1repo-1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = matching.match_names(df, "text", spark.createDataFrame([(n,) for n in names], "name string"), "name", "id")
    want = sorted((i, n) for i, t in enumerate(texts) for n in names if re.search(rf"\b{re.escape(n)}\b", t, re.IGNORECASE))
    assert sorted((r.id, r.name) for r in got.collect()) == want


def brute(vectors, queries, k):
    out = set()
    for q, qv in queries:
        d = sorted((float(((np.array(v) - np.array(qv)) ** 2).sum()), i) for i, v in vectors)
        out |= {(q, rank + 1, i) for rank, (_, i) in enumerate(d[:k])}
    return out


@pytest.fixture(scope="module")
def cloud():
    gen = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in gen.normal(size=8).astype("float32")]) for i in range(500)]
    vecs += [(500 + i, vecs[i][1]) for i in range(20)]
    return vecs, [(q, [float(x) for x in gen.normal(size=8)]) for q in range(7)]


def test_vector_topk_equals_brute_force(spark, cloud, monkeypatch):
    vecs, qs = cloud
    df = spark.createDataFrame(vecs, "id int, embedding array<float>").repartition(6)
    want = brute(vecs, qs, 10)
    assert {(r.query_id, r["rank"], r.id) for r in vector.vector_topk(df, qs, 10).collect()} == want
    monkeypatch.setattr(vector, "QUERIES_PER_PASS", 2)
    table = spark.createDataFrame(qs, "query_id int, vector array<double>")
    assert {(r.query_id, r["rank"], r.id) for r in vector.vector_topk(df, table, 10).collect()} == want
    paged = vector.vector_topk(df, qs, 4, offset=6).collect()
    assert {(r.query_id, r["rank"], r.id) for r in paged} == {w for w in want if w[1] > 6}


def test_approximate_search_recall(spark, cloud):
    vecs, qs = cloud
    df = spark.createDataFrame(vecs, "id int, embedding array<float>")
    table = spark.createDataFrame(qs, "query_id int, vector array<double>")
    near = vector.vector_ann(df, table, 10)
    got = [r.recall for r in vector.recall(vector.vector_topk(df, table, 10), near).collect()]
    assert len(got) == len(qs) and sum(got) / len(got) >= 0.9


def test_encoders(spark):
    df = spark.createDataFrame([(1, "red blue"), (2, "red blue"), (3, "green")], "id int, text string")
    a, b, c = [r.embedding for r in vector.hash_embed(df, "text", dim=16).orderBy("id").collect()]
    assert a == b != c and sum(x * x for x in a) == pytest.approx(1.0, rel=1e-6)
    made = vector.encode(df, "text", lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("id").collect()
    assert made[0].embedding == [8.0, 1.0]


def test_reply_depths(spark):
    chain = [("c", f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    branch = [("c", "b1", "n3"), ("c", "b2", "b1"), ("c", "orphan", "gone")]
    cycle = [("c", "x", "y"), ("c", "y", "x"), ("c", "z", "x"), ("d", "n0", None)]
    df = spark.createDataFrame(chain + branch + cycle, "conversation_id string, message_id string, parent_id string")
    got = {(r.conversation_id, r.message_id): r.depth for r in reply_depths(df).collect()}
    want = {("c", f"n{i}"): i for i in range(40)} | {("c", "b1"): 4, ("c", "b2"): 5, ("c", "orphan"): 0, ("d", "n0"): 0}
    assert got == want


def test_bm25_list_and_table_of_queries_agree(spark):
    docs = [(f"d{i}", " ".join(rng.choice(["red", "blue", "green", "The", "été", "x1"]) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    df = spark.createDataFrame(docs, "id string, text string").repartition(5)
    queries = [("a", "Red the"), ("b", "été x1 blue"), ("c", "absent")]
    table = spark.createDataFrame(queries, "query_id string, query string")
    inline, joined = fulltext.bm25(df, queries, 10).collect(), fulltext.bm25(df, table, 10).collect()
    assert sorted(inline) == sorted(joined) and {r.query_id for r in inline} == {"a", "b"}


def test_bm25_rows_of_one_id_are_one_document(spark):
    apart = spark.createDataFrame([("a", "red blue"), ("a", "red green"), ("b", "blue"), ("c", None)], "id string, text string")
    whole = spark.createDataFrame([("a", "red blue red green"), ("b", "blue"), ("c", "")], "id string, text string")
    table = spark.createDataFrame([("q", "red blue")], "query_id string, query string")
    results = [sorted(fulltext.bm25(df, q, 5).collect()) for df in (apart, whole) for q in ([("q", "red blue")], table)]
    assert all(r == results[0] for r in results) and len(results[0]) == 2


def test_percentile_of_small_values_uses_many_buckets(spark):
    df = spark.createDataFrame([("k", i * 1e-8) for i in range(2001)] + [("k", -5.0)], "k string, v double")
    assert exact_percentile(df, ["k"], "v", 0.5, "p").first().p == pytest.approx(999.5e-8 + 0.0, rel=1e-6)


def test_vectors_of_other_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "id int, embedding array<double>")
    got = vector.vector_topk(df, [("a", [1.0, 2.0]), ("b", [0.0, 0.0, 0.0])], 5).collect()
    assert sorted((r.query_id, r.id) for r in got) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="no query has as many"):
        vector.vector_topk(df, [("a", [1.0, 2.0])], 5).collect()


def test_a_few_dozen_terms_are_matched_without_python(spark):
    """More terms than one scan expression takes, as a list and as a table."""
    terms = [f"t{i}x" for i in range(40)] + ["Ä", "Ab"]
    rows = spark.createDataFrame([(0, "T3X t39x", None), (1, None, "äb aB"), (2, "none", "of them"), (3, None, None)], "id int, a string, b string")
    found = matching.match_terms(rows, ["a", "b"], terms, "term")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(0, "t39x"), (0, "t3x"), (1, "Ab"), (1, "Ä")]
    assert sorted((r["id"], r["term"]) for r in found.collect()) == want
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    assert sorted((r["id"], r["term"]) for r in matching.match_terms(rows, ["a", "b"], table, "term").collect()) == want
