"""Sharding, top-k search, near-duplicates, mixing and packing against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import mixing, near_dedup, packing, pivot_topk, queries, sharding, shingles
from tests.llm import samples

BYTE = public_tokenizers.path(queries.BYTE_BPE)


def test_sharding(spark):
    hot = [(100 + i, "hot text", "en", "a", 8, *samples.CLASH) for i in range(300)]
    pairs = [(1000 + i, f"pair number {i // 2} " * (i % 5 + 1) if i % 2 else f"pair number {i // 2} " * ((i + 1) % 5 + 1), "en", "a", 1, *samples.CLASH) for i in range(400)]
    small = [r for r in samples.rows() if len(r[1] or "") < 1000]
    data = hot + pairs + small
    got = sharding.shard_documents(samples.frame(spark, data), 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(4))
    assert max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values())
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    split = sum(len(where[zlib.crc32(p[1].encode())]) > 1 for p in pairs)
    assert split <= 0.1 * len(pairs)
    assert sharding.shard_documents(samples.empty(spark)).collect() == []


def test_large_groups_lie_in_no_more_shards_than_they_need(spark):
    texts = ["hot text here"] * 1000 + ["nine tenths."] * 180 + ["other group"] * 60 + [f"text number {i:05d}" for i in range(1640)]
    data = [(i, t, "en", "a", len(t), *samples.CLASH) for i, t in enumerate(texts)]
    where, sizes = defaultdict(set), Counter()
    for r in sharding.shard_documents(samples.frame(spark, data), 16).collect():
        where[r.text_crc32].add(r.shard)
        sizes[r.shard] += r["size"]
    share = sum(sizes.values()) / 16
    for text in dict.fromkeys(texts[:1240]):
        need = -(-texts.count(text) * (len(text) + 1) // share)
        assert len(where[zlib.crc32(text.encode())]) <= need, text
    assert max(sizes.values()) - min(sizes.values()) <= 0.2 * share


def test_groups_stay_whole_when_every_row_is_linked(spark):
    texts = [f"text number {i // 2:05d} " + "x" * (i // 2 % 7) for i in range(4000)]
    data = [(i, t, "en", "a", len(t), *samples.CLASH) for i, t in enumerate(texts)]
    where, sizes = defaultdict(set), Counter()
    for r in sharding.shard_documents(samples.frame(spark, data), 16).collect():
        where[r.text_crc32].add(r.shard)
        sizes[r.shard] += r["size"]
    assert sum(len(s) == 1 for s in where.values()) >= 0.9 * len(where)
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values())


def test_leavers_make_room():
    swaps = [(0, 1, 0, 10), (1, 0, 0, 10)]
    assert sharding.admitted(swaps, {0: 100, 1: 100}, 100) == {0: 0, 1: 0}
    assert sharding.admitted([(0, 1, 0, 10), (0, 1, 1, 10), (1, 0, 0, 10)], {0: 100, 1: 100}, 100) == {0: 0, 1: 0}
    assert sharding.admitted([(0, 1, 0, 10), (2, 0, 3, 10)], {0: 100, 1: 100, 2: 50}, 100) == {0: -1, 1: -1, 2: -1}
    assert sharding.admitted([], {0: 1}, 5) == {0: -1}


def test_propagation_gathers_a_linked_path(spark):
    labels = spark.createDataFrame([(i, 1, i % 2, 2) for i in range(8)], "id bigint, size bigint, shard int, degree bigint")
    links = spark.createDataFrame([x for i in range(7) for x in ((i, i + 1), (i + 1, i))], "a bigint, b bigint")
    got = {r.id: r.shard for r in sharding.propagate(labels, links, 8, 2, 8).collect()}
    assert sum(got[i] != got[i + 1] for i in range(7)) <= 2  # seven cut edges before


def brute_topk(rows, every, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for row, (q, v) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(good) if other != row and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return Counter(out)


@pytest.mark.parametrize("blocks", [(8192, 512), (7, 3)])
def test_topk(spark, monkeypatch, blocks):
    monkeypatch.setattr(pivot_topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(pivot_topk, "QUERIES", blocks[1])
    monkeypatch.setattr(pivot_topk, "STEP", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)] + [(100 + i, [0.5, 0.25, -1.0, 0.0, 2.0]) for i in range(30)]
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (210, [1.0, 3.0]), (None, [1.0] * 5)]
    rows += [(0, rows[0][1]), (5, rows[7][1]), (5, rows[8][1]), (100, [0.5, 0.25, -1.0, 0.0, 2.0])]  # ids again, queries' too
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    got = Counter(map(tuple, pivot_topk.top_k(frame, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute_topk(rows, 5, 5)
    assert pivot_topk.top_k(frame.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    monkeypatch.setattr(pivot_topk, "MOST_LENGTHS", 1)
    with pytest.raises(ValueError, match="lengths"):
        pivot_topk.top_k(frame, F.col("vec_id") % 5 == 0)


def words(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]


def bag(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    texts = sorted({t or "" for _, t, *_ in rows})
    bags, top = [bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= threshold:
                top = [top[j] if x == top[i] else x for x in top]
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[top[texts.index(t or "")]].append(i)
    return [min((i for i in ids[top[texts.index(t or "")]] if i is not None), default=None) for _, t, *_ in rows]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    chain = [(500 + i, " ".join(f"c{k}" for k in range(i * 3, i * 3 + 60)), "en", "a") for i in range(6)]  # each near to the next only
    lines = [(600, "the same five words here " * 20 + "and a tail of its own", "en", "a"), (601, "the same five words here " * 19 + "and a tail of its own", "en", "a"),
             (602, "the same five words here " * 3 + "and a tail of its own", "en", "a")]
    rows = samples.TEXTS + chain + lines
    data = [(*r, 0, *samples.CLASH) for r in rows]
    got = near_dedup.near_duplicates(samples.frame(spark, data)).collect()
    want = Counter((i, c) for (i, *_), c in zip(rows, brute_classes(rows)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    classes = defaultdict(list)
    for r in got:
        classes[r.class_id, r.key if r.class_id in (None, 13) else None].append(r)
    for members in classes.values():
        assert sum(r.kept for r in members) == 1 and {r.class_size for r in members} == {len(members)}
    assert near_dedup.near_duplicates(samples.empty(spark)).collect() == []


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base * 3), " ".join(base * 2 + list(rng.permutation(base))), " ".join(base[:20] * 6), "x y"]
    _, w, count = next(shingles.words_of(pa.array([*texts, None, ""])))
    bags = shingles.multisets(w, count)
    sets, m = shingles.elements(*bags, 6), 6_000
    signature = shingles.bag_min_hash(*bags, 6, m)
    for i in range(4):
        for j in range(4):
            a, b = bag(texts[i]), bag(texts[j])
            both = sum((a & b).values())
            exact = both / (sum(a.values()) + sum(b.values()) - both)
            assert shingles.similarity(sets[i], sets[j]) == pytest.approx(exact)
            assert abs((signature[i] == signature[j]).mean() - exact) < 4.5 * np.sqrt(0.25 / m)
    assert np.isinf(signature[4:]).all()


def test_signatures_do_not_depend_on_the_other_texts():
    texts = ["a b c d e f", *(" ".join(f"w{i}x{k}" for k in range(i)) for i in range(1, 400, 7)), "a b c d e f " * 9]
    _, w, count = next(shingles.words_of(pa.array(texts)))
    together = shingles.bag_min_hash(*shingles.multisets(w, count), len(texts), 150)
    for i, text in enumerate(texts):
        _, w, count = next(shingles.words_of(pa.array([text])))
        assert (shingles.bag_min_hash(*shingles.multisets(w, count), 1, 150)[0] == together[i]).all()


@pytest.mark.parametrize("columns", [3, 16_384])
def test_overlaps_equal_pairwise_intersections(columns):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 5, 20, 40, 40, 1)]
    left, right = np.array([1, 1, 1, 0, 0, 0], bool), np.array([0, 0, 1, 1, 1, 1], bool)
    got = shingles.overlaps(sets, left, right, columns)
    for x, i in enumerate(np.flatnonzero(left)):
        for y, j in enumerate(np.flatnonzero(right)):
            assert i == j or got[x, y] == len(np.intersect1d(sets[i], sets[j]))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = pa.array([samples.LONG[:5000], "a b c", samples.LONG[:3000], None])
    whole = [w for _, w, _ in shingles.words_of(texts)]
    monkeypatch.setattr(shingles, "BYTES", 400)
    parts = [w for _, w, _ in shingles.words_of(texts)]
    assert np.concatenate(whole).tolist() == np.concatenate(parts).tolist()


def test_sainte_lague_equals_seat_by_seat():
    rng = np.random.default_rng(3)
    for _ in range(60):
        votes = rng.integers(0, 50, rng.integers(1, 8)).astype(float).tolist()
        most = rng.integers(0, 40, len(votes)).tolist()
        seats, want = int(rng.integers(0, 120)), [0] * len(votes)
        for _ in range(min(seats, sum(m for v, m in zip(votes, most) if v))):
            i = max((i for i in range(len(votes)) if votes[i] and want[i] < most[i]), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        got = mixing.sainte_lague(votes, seats, most)
        assert sum(got) == sum(want) and all(g <= m for g, m in zip(got, most))
        assert Counter(round(v / (2 * s + 1), 9) for v, s in zip(votes, got) if v) == Counter(round(v / (2 * s + 1), 9) for v, s in zip(votes, want) if v)


def test_targets():
    got = mixing.targets({"a": 10, "b": 100, None: 50})
    assert got["a"] == 20 and got[None] == 100 and got["b"] == pytest.approx(120) and sum(got.values()) == pytest.approx(240)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_mixing(spark):
    docs = samples.frame(spark)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in samples.TEXTS)
    sizes = Counter()
    for i, t, _, s in samples.TEXTS:
        sizes[s] += len(words(t))
    target = mixing.targets(dict(sizes))
    taken, source = Counter(), {round(v, 6): k for k, v in target.items()}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[round(r.target, 6)]] += r.taken
        assert r.source_size == sizes[source[round(r.target, 6)]]
    assert all(abs(taken[s] - t) <= max(2, 0.01 * t) for s, t in target.items())
    assert Counter(map(tuple, mixing.mix(docs.repartition(2)).collect())) == Counter(map(tuple, got))  # reruns agree
    made = mixing.take(docs)
    assert made.columns == docs.columns
    per = Counter()
    for r in made.collect():
        per[r.doc_id] += len(words(r[1]))
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert per == +want
    assert mixing.mix(samples.empty(spark)).collect() == [] and mixing.take(samples.empty(spark)).collect() == []


def test_a_tiny_source_leaves_the_others_whole(spark):
    texts = {i: " ".join(f"{i}x{k}" for k in range(300 + i)) for i in range(40)}
    data = [(i, t, "en", "a", 0, *samples.CLASH) for i, t in texts.items()] + [(99, "tiny source of ten words that is all there is", "en", "b", 0, *samples.CLASH)]
    made = defaultdict(list)
    for r in mixing.take(samples.frame(spark, data)).collect():
        made[r.doc_id].append(r[1])
    assert made.pop(99) == [data[-1][1]] * 2
    taken = 0
    for i, some in made.items():
        assert len(some) <= 2 and texts[i] in some
        for line in (x for text in some for x in text.split("\n")):
            words = line.split()
            first, last = int(words[0].split("x")[1]), int(words[-1].split("x")[1])
            assert words == texts[i].split()[first:last + 1] and (len(words) >= 128 or first == 0 or last == 299 + i)
            taken += len(words)
    assert len(made) == 40 and abs(taken - mixing.targets({"a": sum(300 + i for i in range(40)), "b": 10})["a"]) <= 2


def test_blocks_come_near_the_rest():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        words = int(rng.integers(1, 5000))
        rest = int(rng.integers(0, words))
        size, more = mixing.block_of(rest, words)
        assert 1 <= size <= 256 and more * size <= words and (size >= 128 or more <= 1)
        assert abs(more * size - rest) <= (0 if rest <= 256 else max(2, 0.01 * rest))
    assert mixing.block_of(1_000_003, 2_000_000)[1] * mixing.block_of(1_000_003, 2_000_000)[0] == pytest.approx(1_000_003, abs=1)


def test_copies_take_the_words_of_the_chosen_blocks():
    text = "a b c d e f g h"
    assert mixing.copies(text, 0, 2, 4, 4, 0) == [text]
    some = mixing.copies(text, 0, 2, 6, 4, 1)
    assert some[0] == text and len(some[1].split()) == 4
    assert mixing.copies(text, 0, 2, 0, 4, 0) == [] and mixing.copies("", 0, 2, 3, 4, 0) == []


def best_fit(counts, capacity):
    free, used = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r, n in free.items() if n and r >= length), default=None)
            used += room is None
            free[capacity if room is None else room] -= room is not None
            free[(capacity if room is None else room) - length] += 1
    return used


@pytest.mark.parametrize("capacity,n,low,high", [(2048, 3000, 1, 2048), (2048, 2000, 300, 2048), (2048, 1500, 1, 400), (10, 60, 1, 10), (7, 100, 1, 7), (1, 5, 1, 1), (64, 0, 1, 64)])
def test_plan(capacity, n, low, high):
    lengths = np.random.default_rng(n).integers(low, high + 1, n)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan, used = packing.plan_sequences(counts, capacity)
    bins, seen = defaultdict(list), Counter()
    for length, first, pieces, start, each, offset in plan.tolist():
        assert first == seen[length]
        seen[length] += pieces
        for i in range(pieces):
            bins[start + i // each].append((offset + i % each * length, length))
    assert seen == Counter(counts) and len(bins) == used
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert used <= max(best_fit(counts, capacity) * 1.01, best_fit(counts, capacity) + 1)


def test_packing(spark):
    whole = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(samples.frame(spark), BYTE, capacity=128).collect()
    want = Counter()
    for i, t, *_ in samples.TEXTS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids) + 1, 128)]
        for piece, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, piece, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(n for _, n in x) <= 128
    assert packing.pack_documents(samples.empty(spark), BYTE).collect() == []
