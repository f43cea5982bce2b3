"""Filter audit and Merkle manifest against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from colloquy.llm import filter_audit, merkle, oracle
from tests.llm import samples
from tools.compare import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(text, doc_id, first):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    flags = [
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), any(c in "#$%&*|" for c in text),
        doc_id is not None and doc_id > first,
    ]
    return {name for name, fails in zip("ABCDE", flags) if fails}


def brute_audit(docs, labels):
    """Orders walked one by one, document by document."""
    ids = defaultdict(list)
    for doc_id, text, _ in docs:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    signs = {name: {i for i, *s in labels if i is not None and s[k] == 1} for k, name in enumerate(("good", "toxic"))}
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        parts[source or ""].append((failing(text or "", doc_id, min(ids[text or ""], default=0)), doc_id in signs["good"], doc_id in signs["toxic"]))
    out = []
    for part, rows in parts.items():
        steps, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone, kept = [r for r in left if name in r[0]], [r for r in left if name not in r[0]]
                total = sum(name in r[0] for r in rows)
                alone = sum(r[0] == {name} for r in rows)
                steps.append((part, "".join(order), step, len(kept), len(gone), total - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone), name))
                shapley[name] += len(gone)
                left = kept
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


AUDIT_TEXTS = [
    "word " * 300, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(300)), "a$b", "", None, " \t\n", "ABC def", "word " * 300,
    " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "é" * 50 + "A", "é" * 49 + "A", "x y " * 200, "A\x1cB c|d",
]


def test_audit(spark):
    docs = [(i if i % 11 else None, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(AUDIT_TEXTS * 3)] + [(7, "ABC def", "a"), (7, "ABC def", "a")]
    labels = [(i, i % 3 and 1, i % 2) for i in range(20)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, source string, part string, mask int").repartition(5)
    signs = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = filter_audit.audit(filter_audit.failure_masks(frame, signs))
    assert got.columns == [c.split()[0] for c in filter_audit.STEPS.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert filter_audit.audit(filter_audit.failure_masks(samples.empty(spark), signs)).collect() == []


def test_audit_sql_on_awkward_texts(spark):
    docs = [(i, t, ("a", None, "")[i % 3]) for i, t in enumerate(AUDIT_TEXTS * 2)]
    labels = [(i, i % 2, i % 3 == 1) for i in range(20)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[2] for d in docs]}))
    con.register("labels", pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [int(x[2]) for x in labels]}))
    assert sorted(con.execute(oracle.oracle_sql()["op11_filter_audit"]).fetchall()) == brute_audit(docs, [(i, q, int(t)) for i, q, t in labels])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_reach_every_order(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filter_audit.plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swapped_levels_make_the_same_diagram_as_a_fresh_one():
    weights = {mask: (mask * 7 % 5, mask % 3, mask % 2) for mask in range(32) if mask % 4}
    diagram = filter_audit.Diagram("ABCDE", weights)
    for i in filter_audit.plain_changes(5):
        diagram.swap(i)
        fresh = filter_audit.Diagram("".join(diagram.order), weights)
        assert list(diagram.all_pass_path()) == list(fresh.all_pass_path())


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for lang in langs}
    lower = {lang: tree([leaf_of(r) for r in order[lang]]) for lang in langs}
    upper = tree([lower[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, row in enumerate(order[lang]):
            doc_id, source, _, n, text = row
            bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            folded, siblings = leaf_of((doc_id, source, lang, n + 1, text) if bad else row), []
            for levels, at in ((lower[lang], place), (upper, k)):
                for nodes in levels[:-1]:
                    other = nodes[at ^ 1:(at ^ 1) + 1]
                    siblings += other
                    folded = h(*other, folded) if at % 2 else h(folded, *other)
                    at //= 2
            out.append((doc_id, leaf_of(row), lower[lang][-1][0], upper[-1][0], h(*siblings), folded, folded == upper[-1][0]))
    return Counter(out)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels, hop", [(12, 4), (2, 1), (4, 2)])
def test_manifest(spark, monkeypatch, levels, hop):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "HOP", hop)
    rows = [(i, "ab"[i % 2], "en" if i < 70 else ("de", "fr", "é", "Z", "", None)[i % 6], i * 3, f"text {i} é") for i in range(101)]
    rows += [(200, None, "alone", None, None), (None, None, None, 5, ""), (None, "a", "en", 5, "x"), (7, "a", "en", 1, "same id"), (7, "a", "en", 1, "same id"), (9, "x", "en", None, "no size")]
    frame = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, LEAF string, place int").repartition(4)
    got = merkle.manifest(frame)
    assert got.columns == MANIFEST
    assert Counter(tuple(r) for r in got.collect()) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2])
def test_manifest_of_a_small_table(spark, n):
    rows = [(i, "a", "xy"[i], 3, "t") for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert Counter(tuple(r) for r in merkle.manifest(frame).collect()) == brute_manifest(rows)


def test_manifest_of_awkward_documents_and_none(spark):
    rows = [(i, source, lang, len(t or ""), t) for i, t, lang, source in samples.TEXTS]
    assert Counter(tuple(r) for r in merkle.manifest(samples.frame(spark)).collect()) == brute_manifest(rows)
    empty = merkle.manifest(samples.empty(spark))
    assert empty.columns == MANIFEST and empty.collect() == []


def test_manifest_sql(spark):
    rows = [(i, ("a", None)[i % 2], ("en", "en", "de", None)[i % 4], None if i % 5 == 0 else i, f"text {i} é" if i % 9 else None) for i in range(60)]
    con = duckdb.connect()
    names = ("doc_id", "source", "lang", "n_chars", "text")
    con.register("documents", pa.table({n: pa.array([r[k] for r in rows], pa.int64() if k in (0, 3) else pa.string()) for k, n in enumerate(names)}))
    cur = con.execute(oracle.oracle_sql()["op13_merkle"])
    assert rows_of([c[0] for c in cur.description], cur.fetchall()) == rows_of(MANIFEST, list(brute_manifest(rows).elements()))


def test_a_full_block_is_climbed_in_one_hop(spark):
    """Rows of nodes between a block's leaves and its top would each cost a step of the recursion, with its shuffles."""
    rows = [(0, i, bytes([i % 256]) * 32, 5000) for i in range(5000)]
    built = merkle._climbed(spark.createDataFrame(rows, "tree bigint, place bigint, digest binary, n bigint"), 0)
    assert sorted(r["count"] for r in built.groupBy("block").count().collect()) == [905, 4097]
