"""Multisets of word shingles, and their BagMinHash signatures, for many texts at once in numpy.

Words are runs of other than ASCII white space, ASCII letters in lower case. A text of fewer than five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colloquy.llm.common import worker_cache

WORDS = 5
#: Bytes hashed at once; a longer text is taken in parts that end at white space.
BYTES = 500_000
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values (white space 0, letters without case), white space, powers of an odd base and of its inverse."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    base = 0xD6E8FEB86659FD93
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(BYTES * 2, b, np.uint64)]) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64))))
    return values, white, up, down


def _hash_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their first bytes; `breaks` are byte positions where a new text begins."""
    values, white, up, down = worker_cache("word tables", _tables)
    ink = ~white[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of words, words in each text) for ranges of texts of bounded size; null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if high - low <= 2 * BYTES:
            hashes, starts = _hash_words(data[low:high], offsets[at:end] - low)
            count = np.bincount(np.searchsorted(offsets[at:end + 1] - low, starts, side="right") - 1, minlength=end - at) if len(starts) else np.zeros(end - at, np.int64)
        else:
            white, parts, spot = worker_cache("word tables", _tables)[1], [], low
            while spot < high:
                stop = min(high, spot + BYTES)
                gaps = np.flatnonzero(white[data[spot:stop]]) if stop < high else ()
                stop = spot + int(gaps[-1]) + 1 if len(gaps) else stop
                parts.append(_hash_words(data[spot:stop], np.zeros(0, np.int64))[0])
                spot = stop
            hashes = np.concatenate(parts)
            count = np.array([len(hashes)])
        yield at, hashes, count
        at = end


def multisets(words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, shingles, how often), by text and shingle."""
    ends = np.cumsum(count)
    number = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - np.repeat(ends - count, count)
    hashed = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        weight = np.uint64(pow(GOLDEN, k + 1, 1 << 64))
        part = words[k:] * weight
        inside = np.repeat(count, count)[:len(part)] > place[:len(part)] + k
        hashed[:len(part)] += np.where(inside, part, np.uint64(0))
    whole = (place + WORDS <= np.repeat(count, count)) | (place == 0)
    number, hashed = number[whole], mix(hashed[whole])
    order = np.lexsort((hashed, number))
    number, hashed = number[order], hashed[order]
    new = np.r_[True, (hashed[1:] != hashed[:-1]) | (number[1:] != number[:-1])][:len(hashed)]
    starts = np.flatnonzero(new)
    return number[starts], hashed[starts], np.diff(np.r_[starts, len(hashed)])


def elements(number: np.ndarray, shingle: np.ndarray, often: np.ndarray, texts: int) -> list[np.ndarray]:
    """Each text's multiset as a sorted set: a shingle's n-th occurrence is an element of its own."""
    nth = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
    every = mix(np.repeat(shingle, often) + nth.astype(np.uint64) * np.uint64(GOLDEN))
    owner = np.repeat(number, often)
    order = np.lexsort((every, owner))
    return np.split(every[order], np.cumsum(np.bincount(owner, minlength=texts))[:-1]) if texts else []


def bag_min_hash(number: np.ndarray, shingle: np.ndarray, often: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts x size): the first arrival at each place, infinite for texts without shingles.

    A shingle's weight axis is cut at powers of two: (0,1], (1,2], (2,4], ... Each interval that begins below the shingle's
    weight has a Poisson process of rate its length, seeded by shingle and interval, whose points carry a place and a level
    (the path down the interval's halves). Points above the weight are passed over; a process ends once it is later than
    every place's first arrival. Equal arrivals of two texts at a place have the probability of their weighted Jaccard.
    """
    first = np.full((texts, size), np.inf)
    if not len(shingle):
        return first
    n_intervals = np.ceil(np.log2(often)).astype(np.int64) + 1
    j = np.arange(n_intervals.sum()) - np.repeat(np.cumsum(n_intervals) - n_intervals, n_intervals)
    text, weight = np.repeat(number, n_intervals), np.repeat(often, n_intervals)
    low = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0)
    length = np.maximum(low, 1)
    state = mix(np.repeat(shingle, n_intervals) ^ mix((j + 1).astype(np.uint64) * np.uint64(GOLDEN)))
    time, flat = np.zeros(len(text)), first.ravel()
    while len(text):
        points = int(np.clip(20_000 // len(text), 1, 64))
        draws = mix(state[:, None] + np.arange(1, 2 * points + 1, dtype=np.uint64) * np.uint64(GOLDEN))
        state = state + np.uint64(2 * points * GOLDEN & MASK)
        gaps = -np.log(((draws[:, 0::2] >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0 ** -53) / length[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        time = times[:, -1]
        other = draws[:, 1::2]
        place = ((other >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = low[:, None] + 1 + ((other & np.uint64(0xFFFFFFFF)) * length[:, None].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        good = level <= weight[:, None]
        np.minimum.at(flat, (text[:, None] * size + place)[good], times[good])
        late = first.max(axis=1)[text]
        going = time < late
        text, weight, low, length, state, time = (x[going] for x in (text, weight, low, length, state, time))
    return first


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """(texts x bands) 64-bit keys, equal when all of a band's arrivals are."""
    rows = signatures.shape[1] // bands
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN), (len(signatures), bands))
    for k in range(rows):
        keys = mix(keys ^ mix(bits[:, :, k] + np.uint64(GOLDEN)))
    return keys.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted sets of elements."""
    if not len(a) or not len(b):
        return 0.0
    spot = np.searchsorted(b, a)
    both = int((b[np.minimum(spot, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 16_384) -> np.ndarray:
    """How many elements each of the `left` sets shares with each of the `right` ones (both given as flags).

    Elements are looked at in slices of bounded width, as products of membership matrices; those of one set alone are left out.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[where] > 1
    owner, column = owner[shared], number[where[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((int(left.sum()), int(right.sum())))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, z = np.searchsorted(column, (low, low + columns))
        table = np.zeros((len(sets), columns), np.float32)
        table[owner[a:z], column[a:z] - low] = 1
        out += table[left] @ table[right].T
    return out
