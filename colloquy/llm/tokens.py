"""Encoding inside tasks with the tokenizers library, piece by piece, for a column of texts at a time.

A text is cut where no token of the two given pre-tokenizers can lie across: before a blank or line feed that follows a
visible character, before a full stop or comma that follows a letter that lower case leaves one, and between a line feed after a visible character and a letter. The
pieces' ids, joined, are the whole text's ids. Pieces repeat far more often than texts: numpy finds the distinct ones by
64-bit hashes, the library encodes those the worker has not met, and ids are put together by gathering. Memory is bounded
for any number of texts of any length that have such places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colloquy.llm.common import worker_cache
from colloquy.llm.shingles import GOLDEN, mix

#: Bytes cut and encoded at once.
BYTES = 1_000_000
#: Pieces up to this many bytes are kept by the worker, so many of them.
SHORT, KEPT = 64, 1_000_000
#: U+00D7, U+00F7 and U+0130 in UTF-8: signs that are no letters, and a letter whose lower case ends in a combining mark.
NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: A piece that is a word; such pieces are encoded many at once, one after the other.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
    return table


def _hash_values() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN)
    return mix(seeds), mix(mix(seeds[:SHORT + 1])) | np.uint64(1)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions inside `raw` (UTF-8) where a piece begins."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    letters = _letters()
    before, at = raw[:-1], raw[1:]
    latin = np.zeros(len(before), bool)  # the second byte of a character from U+00C0 to U+027F
    latin[1:] = (raw[:-2] >= 0xC3) & (raw[:-2] <= 0xC9) & (before[1:] >= 0x80) & (before[1:] < 0xC0)
    sign = np.zeros(len(before), bool)
    for lead, second in NO_LETTERS:
        sign[1:] |= (raw[:-2] == lead) & (before[1:] == second)
    visible, letter = (before > 32) & (before < 127) | latin, letters[before] | latin & ~sign
    stop = (at == 32) | (at == 10)
    out = stop & visible | ((at == 46) | (at == 44)) & letter
    out[1:] |= (before[1:] == 10) & visible[:-1] & letters[at[1:]]
    return np.flatnonzero(out) + 1


class PieceEncoder:
    """Ids of texts, as the library gives them without special tokens of its own adding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        strings = {i: t for t, i in self.tokenizer.get_vocab().items()}
        table = [strings.get(i, "") for i in range(max(strings) + 1)]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([t.endswith(suffix) for t in table]) if suffix else None
        self.bytes = np.array([len(t) for t in table])  # a byte-level token has a character for each byte
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: list[str], gap: str) -> list[np.ndarray] | None:
        """Ids of words that follow each other with `gap` between; None unless every word is seen to begin and end with a token."""
        ids = np.array(self.tokenizer.encode_batch_fast([gap.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        if self.last is not None:
            stops = np.flatnonzero(self.last[ids]) + 1
            starts = np.r_[0, stops[:-1]]
            whole = len(stops) == len(words) and (not len(stops) or stops[-1] == len(ids))
        else:
            size = np.array([len(w.encode()) for w in words])
            end = np.cumsum(size + len(gap)) - len(gap)
            place = np.r_[0, np.cumsum(self.bytes[ids])]
            starts, stops = (np.searchsorted(place, x) for x in (end - size, end))
            whole = place[-1] == end[-1] and (place[starts] == end - size).all() and (place[stops] == end).all()
        return [ids[a:z] for a, z in zip(starts.tolist(), stops.tolist())] if whole else None

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        found = [(i, p) for i, p in enumerate(pieces) if WORD.fullmatch(p)]
        for gap, group in (("", [x for x in found if x[1][0] == " "]), ("\n", [x for x in found if x[1][0] != " "])):
            for at in range(0, len(group), 4096):
                some = group[at:at + 4096]
                for (i, _), ids in zip(some, self._words([p for _, p in some], gap) or ()):
                    out[i] = ids
        return [self.ids(p) if x is None else x for p, x in zip(pieces, out)]

    def _segment(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of `raw` that begin at `starts`, joined, and the number of ids of each."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        values, powers = worker_cache("piece hashes", _hash_values)
        size = np.diff(np.r_[starts, len(raw)])
        place = np.arange(len(raw)) - np.repeat(starts, size)
        hashed = mix(np.add.reduceat(values[raw] * powers[np.minimum(place, SHORT)], starts) + size.astype(np.uint64) * np.uint64(GOLDEN))
        data = raw.tobytes()
        for i in np.flatnonzero(size > SHORT):
            hashed[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:starts[i] + size[i]], digest_size=8).digest(), "little")
        unique, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, unique)
        hit = self.known[np.minimum(spot, len(self.known) - 1)] == unique if len(self.known) else np.zeros(len(unique), bool)
        begin, n = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        begin[hit], n[hit] = self.start[spot[hit]], self.length[spot[hit]]
        new = np.flatnonzero(~hit)
        flat = self.flat
        if len(new):
            at, size = starts[first[new]], size[first[new]]
            found = self._encode([data[a:a + s].decode("utf-8", "replace") for a, s in zip(at.tolist(), size.tolist())])
            n[new] = [len(x) for x in found]
            begin[new] = len(flat) + np.cumsum(n[new]) - n[new]
            flat = np.concatenate([flat, *found])
            keep = new[size <= SHORT]
            if len(self.known) + len(keep) > KEPT:
                self._forget()
            else:
                self.known = np.insert(self.known, spot[keep], unique[keep])
                self.start, self.length = np.insert(self.start, spot[keep], begin[keep]), np.insert(self.length, spot[keep], n[keep])
                self.flat = flat if len(keep) == len(new) else self._trim(flat, keep, begin, n)
        each = n[which]
        ends = np.cumsum(each)
        return flat[np.arange(ends[-1]) + np.repeat(begin[which] - (ends - each), each)], each

    def _trim(self, flat: np.ndarray, keep: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The kept pieces' ids only; long pieces' ids are dropped."""
        old = len(self.flat)
        spot = np.flatnonzero(self.start >= old)
        order = spot[np.argsort(self.start[spot], kind="stable")]
        parts = [flat[a:a + k] for a, k in zip(self.start[order].tolist(), self.length[order].tolist())]
        self.start[order] = old + np.cumsum(self.length[order]) - self.length[order]
        return np.concatenate([self.flat, *parts])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of a range of texts, ends of each text's ids) for the whole column; null as empty."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
            low, high = int(offsets[at]), int(offsets[end])
            if high - low <= 2 * BYTES:
                raw, edges = data[low:high], offsets[at:end + 1] - low
                new = np.zeros(len(raw), bool)
                new[edges[:-1][edges[:-1] < edges[1:]]] = new[cuts(raw)] = True
                begins = np.flatnonzero(new)
                ids, each = self._segment(raw, begins)
                total = np.r_[0, np.cumsum(each)]
                ends = total[np.searchsorted(begins, edges[1:])]
            else:
                parts = []
                while low < high:
                    window = BYTES
                    while True:
                        raw = data[low:min(high, low + window)]
                        inside = cuts(raw)
                        if low + window >= high or len(inside):
                            break
                        window *= 2
                    raw = raw if low + window >= high else raw[:inside[-1]]
                    parts.append(self._segment(raw, np.r_[0, inside[inside < len(raw)]])[0])
                    low += len(raw)
                ids = np.concatenate(parts)
                ends = np.array([len(ids)])
            yield at, ids, ends
            at = end


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for the tokenizer file at `path`."""
    return worker_cache(("tokenizer", path), lambda: PieceEncoder(path))
