"""Substring deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import substring
from tests.llm import samples


def brute(rows, window):
    """rows: doc_id, text."""
    first = {}
    texts = [(1 << 63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for key, words in texts:
        for k in range(len(words) - window + 1):
            s = tuple(words[k:k + window])
            first[s] = min(first.get(s, key), key)
    out = []
    for (i, _), (key, words) in zip(rows, texts):
        gone = {p for k in range(len(words) - window + 1) if first[tuple(words[k:k + window])] < key for p in range(k, k + window)}
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(w for p, w in enumerate(words) if p not in gone)).hexdigest()))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, part int, TEXT string").repartition(5)


def made_up(n, words, vocabulary, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(words)))) for i in range(n)]


@pytest.mark.parametrize("contexts, shard", [(16, 6000), (1, 40), (3, 7)])
def test_many_short_repeats(spark, monkeypatch, contexts, shard):
    for name, value in {"CONTEXTS": contexts, "SHARD_WINDOWS": shard, "STREAMED": 50, "PIECE": 11, "BLOCK": 16, "SLICE": 100, "ANCHOR": 2}.items():
        monkeypatch.setattr(substring, name, value)
    rows = made_up(150, 60, ["a", "b", "B", "cé"], 1) + [(7, "a b a b a b a b a b"), (7, "a b a b a b a b a b"), (None, "a b a b a b a b c"), (None, "a b a b a b a b c"), (500, None), (501, ""), (502, " a\tb\x0ba  b a\nb ")]
    got = substring.remove_repeats(frame(spark, rows), 5, keep_text=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute(rows, 5)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("contexts", [16, 2])
def test_passages_copies_and_a_common_phrase(spark, monkeypatch, contexts):
    monkeypatch.setattr(substring, "CONTEXTS", contexts)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, f"{t} {' '.join(random.Random(i).choice(vocabulary) for _ in range(100))}") for i, t in made_up(60, 120, vocabulary, 2)]
    passage, phrase = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("p", 64), ("q", 45)))
    for i in range(100, 160):
        rows.append((i, f"{rows[i % 40][1]} {passage if i % 2 else phrase} {rows[i % 37][1]}"))
    rows += [(200, passage), (201, passage), (202, rows[3][1]), (50, rows[3][1]), (203, " ".join([passage] * 3)), (204, " ".join(passage.split()[:50])), (205, " ".join(passage.split()[:49]))]
    assert Counter(tuple(r) for r in substring.remove_repeats(frame(spark, rows)).collect()) == brute(rows, 50)


def test_awkward_documents(spark):
    rows = [r[:2] for r in samples.rows()]
    got = substring.remove_repeats(samples.frame(spark))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 50)
    assert substring.remove_repeats(samples.empty(spark)).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 500).astype(np.uint64)
    seen = {}
    owner, start, stop, anchor, _ = substring.anchored(words, np.array([180, 0, 320]), 9, 3)
    covered = []
    for own, a, z, key in zip(owner, start, stop, anchor):
        at = (0, 180, 180)[own]
        for k in range(a, z - 8):
            covered.append((own, k))
            assert seen.setdefault(tuple(words[at + k:at + k + 9]), key) == key
    assert sorted(covered) == [(0, k) for k in range(172)] + [(2, k) for k in range(312)]


def test_automaton_knows_the_smallest_id_of_every_window():
    rng = random.Random(4)
    texts = [(rng.randrange(20), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))]) for _ in range(30)]
    automaton = substring.Automaton(texts)
    for window in (1, 3, 6):
        first = {}
        for doc, words in texts:
            for k in range(len(words) - window + 1):
                s = tuple(words[k:k + window])
                first[s] = min(first.get(s, doc), doc)
        for doc, words in texts:
            gone = {p for k in range(len(words) - window + 1) if first[tuple(words[k:k + window])] < doc for p in range(k, k + window)}
            spans = automaton.repeats(doc, words, window)
            assert gone == {p for a, z in spans for p in range(a, z)}
