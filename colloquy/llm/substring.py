"""Substring deduplication by suffix automata of reference shards.

A span of a document goes when every word of it lies in a window of `window` words that also stands in a document of a
smaller id. Suffix automata over reference texts find such spans: a document streamed through one gets, word by word, the
longest match so far, and each state knows the smallest id among the places where its strings end.

The references are the parts of the corpus that can matter. Every window has an anchor, the run of ANCHOR words in it with
the least hash, so equal windows have equal anchors; neighbouring windows share theirs. A stretch of windows with one anchor
becomes a reference when its anchor stands in several documents, and once only, from the smallest id, when several have the
same stretch. An anchor of more than CONTEXTS different stretches (a common phrase among other words) is replaced by its
windows themselves, each an anchor of its own: a window then is a reference once. References are dealt to shards of bounded
size. A corpus' references grow with it, so no shard is sent everywhere: a document's stretches go to the shards that hold
their anchors only, at most CONTEXTS, and a shard that many documents visit is given to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Scratch, pick, release

WINDOW, ANCHOR = 50, 16
CONTEXTS = 16
#: Windows of reference in a shard, about; a shard's stretches of a document come from blocks of so many words.
SHARD_WINDOWS, BLOCK = 6_000, 4_096
#: Words streamed through one copy of a shard's automaton, about; words of a piece that is streamed at once.
STREAMED, PIECE = 200_000, 20_000
SLICE = 400_000
BASE = 0xD6E8FEB86659FD93
NO_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Stretches:
    """Hashes of any stretch of consecutive words, from sums over all of them."""

    def __init__(self, words: np.ndarray):
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(words), np.uint64(BASE))])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(len(words), np.uint64(pow(BASE, -1, 1 << 64)))])
        self.sums = np.r_[np.uint64(0), np.cumsum(words * up[:len(words)])]

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def anchored(words: np.ndarray, count: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text number, first word, end, anchor, hash of the stretch) of each stretch of windows with one anchor."""
    n, ends = len(words), np.cumsum(count)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    stretches, at = Stretches(words), np.arange(n - anchor + 1)
    least, where, width = stretches.hash(at, at + anchor), at, 1
    grams = least
    while width < window - anchor + 1:  # the leftmost least one among the `width` that begin at each place
        step = min(width, window - anchor + 1 - width)
        later = least[step:] < least[:-step]
        least, where = np.where(later, least[step:], least[:-step]), np.where(later, where[step:], where[:-step])
        width += step
    whole = np.arange(len(where)) + window <= np.repeat(ends, count)[:len(where)]
    turn = np.r_[True, (where[1:] != where[:-1]) | ~whole[1:] | ~whole[:-1], True]
    start, stop = np.flatnonzero(whole & turn[:-1]), np.flatnonzero(whole & turn[1:]) + window
    owner = np.searchsorted(ends, start, side="right")
    first = start - (ends - count)[owner]
    return owner, first, first + stop - start, grams[where[start]], stretches.hash(start, stop)


class Automaton:
    """A suffix automaton of several texts; `least` has the smallest id among the texts where a state's strings end."""

    def __init__(self, texts: list[tuple[int, list[bytes]]]):
        self.to: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NO_ID]
        for doc, words in texts:
            state = 0
            for word in words:
                state = self._extend(state, word)
                self.least[state] = min(self.least[state], doc)
        for state in sorted(range(1, len(self.to)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            self.least[above] = min(self.least[above], self.least[state])

    def _state(self, to: dict[bytes, int], link: int, length: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NO_ID)
        return len(self.to) - 1

    def _split(self, state: int, word: bytes, old: int) -> int:
        """The state of the longest string that reaches `old` from `state` or above by `word`; it takes over from `old`."""
        new = self._state(dict(self.to[old]), self.link[old], self.length[state] + 1)
        self.link[old] = new
        while state >= 0 and self.to[state].get(word) == old:
            self.to[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, state: int, word: bytes) -> int:
        known = self.to[state].get(word)
        if known is not None:
            return known if self.length[known] == self.length[state] + 1 else self._split(state, word, known)
        new = self._state({}, 0, self.length[state] + 1)
        while state >= 0 and word not in self.to[state]:
            self.to[state][word] = new
            state = self.link[state]
        if state >= 0:
            known = self.to[state][word]
            self.link[new] = known if self.length[known] == self.length[state] + 1 else self._split(state, word, known)
        return new

    def repeats(self, doc: int, words: list[bytes], window: int) -> list[list[int]]:
        """Maximal [start, stop) of `words` covered by windows that stand in a text of a smaller id."""
        to, link, length, least = self.to, self.link, self.length, self.least
        state, matched, spans = 0, 0, []
        for stop, word in enumerate(words, 1):
            after = to[state].get(word)
            while after is None and state:
                state = link[state]
                matched = length[state]
                after = to[state].get(word)
            if after is None:
                continue
            state, matched = after, matched + 1
            if matched >= window:
                while length[link[state]] >= window:  # the state of the last window, whatever came before it
                    state = link[state]
                    matched = length[state]
                if least[state] < doc:
                    if spans and stop - window <= spans[-1][1]:
                        spans[-1][1] = stop
                    else:
                        spans.append([stop - window, stop])
        return spans


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _stretches(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, context (hash of the stretch), doc, part, start, stop."""
    names = ["anchor", "context", "doc", "part", "start", "stop"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts = (batch.column(c).to_numpy() for c in ("doc", "part"))
            waiting, hashes, numbers = 0, [], []
            for i, text in enumerate([*_texts(batch), None]):
                if text is not None:
                    hashes.append(word_hashes(text.split()))
                    numbers.append(i)
                    waiting += len(hashes[-1])
                if numbers and (text is None or waiting >= SLICE):
                    count = np.array([len(h) for h in hashes])
                    owner, start, stop, key, context = anchored(np.concatenate(hashes), count, window, anchor)
                    own = np.array(numbers)[owner]
                    columns = key.view(np.int64), context.view(np.int64), docs[own], parts[own], start.astype(np.int32), stop.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                    waiting, hashes, numbers = 0, [], []
        release()

    return texts.mapInArrow(find, "anchor bigint, context bigint, doc bigint, part bigint, start int, stop int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """anchor (hash of the window), doc, part, start, stop of every window in each text's `spots` (start, stop)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spots, doc, part in zip(_texts(batch), *(batch.column(c).to_pylist() for c in ("spots", "doc", "part"))):
                words = word_hashes(text.split())
                start = np.unique(np.concatenate([np.arange(s["start"], s["stop"] - window + 1) for s in spots]))
                key = Stretches(words).hash(start, start + window).view(np.int64)
                columns = key, np.full(len(start), doc), np.full(len(start), part), start.astype(np.int32), (start + window).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "doc", "part", "start", "stop"])
        release()

    return texts.mapInArrow(find, "anchor bigint, doc bigint, part bigint, start int, stop int")


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """shard, ref, doc, part, start, words, n: the words of each text's `units` (shard, ref, start, stop), overlaps made one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, units, doc, part in zip(_texts(batch), *(batch.column(c).to_pylist() for c in ("units", "doc", "part"))):
                words, by_shard, rows = text.split(), {}, []
                for unit in units:
                    by_shard.setdefault((unit["shard"], unit["ref"]), []).append((unit["start"], unit["stop"]))
                for (shard, ref), spans in by_shard.items():
                    for start, stop in joined(spans):
                        for at in range(start, max(start + 1, stop - window + 1), PIECE):  # pieces overlap by a window less a word
                            some = words[at:min(stop, at + PIECE + window - 1)]
                            rows.append((shard, ref, doc, part, at, b" ".join(some).decode(), len(some)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        release()

    names = ["shard", "ref", "doc", "part", "start", "words", "n"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
    return texts.mapInArrow(cut, "shard bigint, ref boolean, doc bigint, part bigint, start int, words string, n int")


def _search(pieces: DataFrame, window: int) -> DataFrame:
    """doc, part, start, stop of repeated spans; `pieces` come sorted by shard and salt, references first."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, references, automaton = None, [], None
        for batch in batches:
            found = []
            for shard, salt, ref, doc, part, start, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "ref", "doc", "part", "start", "words"))):
                if key != (shard, salt):
                    key, references, automaton = (shard, salt), [], None
                own = words.encode().split()
                if ref:
                    references.append((doc, own))
                    continue
                automaton = automaton or Automaton(references)
                found += [(doc, part, start + a, start + z) for a, z in automaton.repeats(doc, own, window)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "part", "start", "stop"])
        release()

    return pieces.mapInArrow(search, "doc bigint, part bigint, start int, stop int")


def repeated_spans(texts: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, part, start, stop (words) of the spans of `texts` (doc, part, text) that repeat documents of smaller ids.

    Spans of a text may overlap. Tables on the way, each written to the shared folder and removed when it is read no more,
    hold hashes and places; texts only of stretches whose anchors stand in several documents.
    """
    spark = texts.sparkSession
    place = ["doc", "part", "start", "stop"]
    # what a join's sides come from is written first: a join of two plain tables splits a key that holds very many rows
    every = scratch.table(_stretches(texts, window, min(anchor, window)), "stretches")
    several = every.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    found = scratch.table(every.join(scratch.table(several, "several"), "anchor"), "found")
    scratch.drop("stretches")
    origin = F.min(F.struct(*place)).alias("r")
    first = scratch.table(found.groupBy("anchor", "context").agg(origin, F.first("high").alias("high")), "first")
    common = scratch.table(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CONTEXTS).select("anchor"), "common")
    sources = first.join(common, "anchor", "left_anti").where("r.doc < high").select("anchor", "r.*")
    if not common.isEmpty():
        spots = found.join(common, "anchor", "left_semi").groupBy("doc", "part").agg(F.collect_set(F.struct("start", "stop")).alias("spots"))
        windows = scratch.table(_windows(texts.join(scratch.table(spots, "spots"), ["doc", "part"]), window), "windows")
        lows = windows.groupBy("anchor").agg(origin, F.max("doc").alias("high")).where("r.doc < high").select("anchor", "r.*")
        sources = sources.union(lows)
    sources = scratch.table(sources, "sources")
    total = sources.agg(F.sum(F.col("stop") - F.col("start") - (window - 1))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WINDOWS))
    number = F.pmod(F.xxhash64("doc", "part", F.expr(f"start div {BLOCK}")), F.lit(shards))
    sources = sources.withColumn("shard", number)
    held = scratch.table(sources.groupBy("anchor", "shard").agg(F.min("doc").alias("from")), "held")

    def visits(rows: DataFrame) -> DataFrame:
        return rows.select("anchor", *place).join(held, "anchor").where(F.col("doc") > F.col("from")).select("shard", F.lit(False).alias("ref"), *place)

    # a common anchor is not among the sources' and so visits no shard, its windows do
    units = sources.select("shard", F.lit(True).alias("ref"), *place).union(visits(found))
    if not common.isEmpty():
        units = units.union(visits(windows))
    units = units.groupBy("doc", "part").agg(F.collect_set(F.struct("shard", "ref", "start", "stop")).alias("units"))
    pieces = scratch.table(_pieces(texts.join(units, ["doc", "part"]), window), "pieces")
    for name in ("several", "found", "first", "common", "spots", "windows", "sources", "held"):
        scratch.drop(name)
    loads = scratch.table(pieces.where("not ref").groupBy("shard").agg(F.ceil(F.sum("n") / STREAMED).alias("salts")), "loads")
    copies = loads.agg(F.sum("salts")).first()[0] or 0
    dealt = pieces.join(loads, "shard").withColumn("salt", F.explode(F.when(F.col("ref"), F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc", "part", "start"), "salts"))))).drop("salts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-copies // 8))
    by_shard = dealt.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", F.desc("ref"))
    spans = scratch.table(_search(by_shard, window), "spans")
    for name in ("pieces", "loads"):
        scratch.drop(name)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with `keep_text` also kept_text, the words that stay.

    Words are runs of other than ASCII white space, compared byte by byte. A word goes when a window of `window` words over
    it also stands in a document of a strictly smaller id, judged on the input. A null text has no words. A null id is larger
    than all others, and rows without id do not repeat each other; nor do rows of one id, or a document itself. Equal rows
    have equal results. Texts shorter than a window keep all words. An empty table gives no rows; other columns are
    ignored. Places are found by 64-bit hashes; what is removed is decided by the words themselves.

    Runs jobs at once; the table of spans stays in the shared folder, as the result reads it.
    """
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("part"), "text")
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = repeated_spans(rows.where("text is not null").select("doc", "part", "text"), scratch, window)
    per_text = spans.groupBy("doc", "part").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for content, own in zip(_texts(batch), batch.column("spans").to_pylist()):
                words = content.split()
                kept, at = [], 0
                for start, stop in joined([(s["start"], s["stop"]) for s in own or ()]):
                    kept += words[at:start]
                    at = stop
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                left = b" ".join(kept)
                digests.append(hashlib.sha256(left).hexdigest())
                texts += [left.decode()] if keep_text else []
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(texts, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:len(columns) + 1])
        release()

    return rows.join(per_text, ["doc", "part"], "left").select("doc_id", "text", "spans").mapInArrow(remove, schema)
