"""Packing documents into sequences: linear grouping of the large pieces, few-size configurations, best fit for the small.

How often each length occurs (a table no longer than a sequence) is all that is needed to plan the sequences. The plan
says where the pieces of each length go by their number within the length, as ranges; Spark numbers the pieces and each
task looks its own up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import n_buckets, pick, release, running_sum, staged
from colloquy.llm.tokens import encoder

CAPACITY = 2048
#: Pieces longer than this share of a sequence are large.
LARGE = 1 / 8
#: Groups of equally many large pieces, each group rounded up to its longest.
GROUPS = 1024
PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text as ids with `end_id` behind, cut into pieces of `capacity`; only a document's first may be shorter."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at, ids, ends in encode.encode(batch.column("text")):
                starts = np.r_[0, ends[:-1]]
                with_end = np.insert(ids, ends, end_id).astype("<u4")  # a text's end id stands behind its ids
                starts, size = starts + np.arange(len(ends)), ends - starts + 1
                pieces = -(-size // capacity)
                which = np.repeat(np.arange(len(ends)), pieces)
                number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (size - 1) % capacity + 1
                begin = np.where(number > 0, first[which] + (number - 1) * capacity, 0)
                length = np.where(number > 0, capacity, first[which])
                place = starts[which] + begin
                sums = [zlib.crc32(with_end[p:p + n]) for p, n in zip(place.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(ends)).take(pa.array(which)), pa.array(number, pa.int32()), pa.array(begin, pa.int64()),
                     pa.array(length, pa.int32()), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class _Plan:
    """Sequences planned so far, as runs: `n` neighbouring sequences that hold the same lengths."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.capacity, self.bins = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, n: int, each: int, first: int, offset: int) -> None:
        """Into `n` sequences from `first`, `each` pieces of `length` from `offset` on."""
        self.rows.append((length, int(self.used[length]), n * each, first, each, offset))
        self.used[length] += n * each
        self.left[length] -= n * each

    def leave(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.open.setdefault(room, []).append((first, n))


def _best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Positions in `sizes` (descending) of a fullest sequence that has the largest size left; bounded subset sums as bits."""
    top = next(i for i, n in enumerate(left) if n)
    room, least = capacity - sizes[top], sizes[-1]
    stages, reach = [], 1
    for i in range(top, len(sizes)):
        for _ in range(min(left[i] - (i == top), room // sizes[i])):
            stages.append((i, reach))
            reach |= (reach << sizes[i]) & ((1 << (room + 1)) - 1)
        if reach >> room or room < least:
            break
    fill, taken = reach.bit_length() - 1, [top]
    for i, before in reversed(stages):
        if fill and not before >> fill & 1:
            taken.append(i)
            fill -= sizes[i]
    return sorted(taken)


def _large(plan: _Plan, least: int, groups: int) -> None:
    """Linear grouping, configurations of the rounded sizes, then the actual lengths in their places."""
    lengths = [s for s in range(plan.capacity - 1, least - 1, -1) if plan.left[s]]
    total = int(sum(plan.left[s] for s in lengths))
    if not total:
        return
    per_group = -(-total // groups)
    members: list[list[list[int]]] = [[]]
    room = per_group
    for s in lengths:  # by falling length, so a group's first is what all its members are rounded up to
        n = int(plan.left[s])
        while n:
            if not room:
                members.append([])
                room = per_group
            take = min(n, room)
            members[-1].append([s, take])
            n, room = n - take, room - take
    sizes, left = [m[0][0] for m in members], [sum(n for _, n in m) for m in members]
    while any(left):
        chosen = _best_configuration(sizes, left, plan.capacity)
        copies = {i: chosen.count(i) for i in chosen}
        n = min(left[i] // k for i, k in copies.items())
        first, plan.bins = plan.bins, plan.bins + n
        runs = [(first, n, 0)]
        for i in chosen:
            left[i] -= n
            after = []
            for start, size, offset in runs:
                while size:
                    s, there = members[i][0]
                    take = min(size, there)
                    plan.place(s, take, 1, start, offset)
                    after.append((start, take, offset + s))
                    start, size = start + take, size - take
                    members[i][0][1] -= take
                    if not members[i][0][1]:
                        members[i].pop(0)
            runs = after
        for start, size, offset in runs:
            plan.leave(plan.capacity - offset, start, size)


def _small(plan: _Plan, below: int) -> None:
    """Best fit by falling length: into the fullest sequence with room, as often as it fits; new sequences for the rest."""
    for s in range(below - 1, 0, -1):
        for room in sorted(r for r in plan.open if r >= s):
            while plan.left[s] and plan.open.get(room):
                first, n = plan.open[room].pop()
                each, left = room // s, int(plan.left[s])
                full = min(n, left // each)
                offset = plan.capacity - room
                if full:
                    plan.place(s, full, each, first, offset)
                    plan.leave(room - each * s, first, full)
                rest = min(left - full * each, each - 1) if full < n else 0
                if rest:
                    plan.place(s, 1, rest, first + full, offset)
                    plan.leave(room - rest * s, first + full, 1)
                plan.leave(room, first + full + (rest > 0), n - full - (rest > 0))
                if not full and not rest:
                    break
        left, each = int(plan.left[s]), plan.capacity // s
        if left:
            full, rest = divmod(left, each)
            for n, k in ((full, each), (1 if rest else 0, rest)):
                if n:
                    plan.place(s, n, k, plan.bins, 0)
                    plan.leave(plan.capacity - k * s, plan.bins, n)
                    plan.bins += n


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces, first sequence, pieces in each, offset), by length and number; sequences used.

    The size of the plan depends on the number of different lengths and groups, not on the number of pieces.
    """
    table = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        table[length] = n
    plan = _Plan(table, capacity)
    if n := int(table[capacity]):
        plan.place(capacity, n, 1, 0, 0)
        plan.bins = n
    least = max(1, int(capacity * LARGE) + 1)
    _large(plan, least, groups)
    _small(plan, min(least, capacity))
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    return rows, plan.bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """`pieces` (a column `length` of 1 to `capacity` among them) with `sequence_id` and `offset`.

    The pieces, small rows, are written to the shared folder first, with a number each; their lengths are counted and at
    most `capacity` counts reach the driver. Pieces are numbered within their length bucket by bucket, so a length that
    a third of them have is numbered in many tasks. Equal lengths are interchangeable: which of them goes where is fixed
    by the written table. An empty table gives no rows.
    """
    numbered = staged(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = plan_sequences(counts, capacity, groups)
    dealt = numbered.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(n_buckets(sum(counts.values())))))
    ranked = running_sum(dealt, ["length"], "__bucket", [F.col("__row")], F.lit(1), "__number").drop("__bucket", "__row")
    keys = plan[:, 0] << 44 | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("__number").to_numpy().astype(np.int64)
            row = plan[np.searchsorted(keys, length << 44 | number, side="right") - 1] if len(plan) else plan
            turn, spot = np.divmod(number - row[:, 1], row[:, 4])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(row[:, 3] + turn), pa.array(row[:, 5] + spot * length)],
                [*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null texts are empty documents of one id, the end. Rows with equal or null ids are packed one by one. Other columns are ignored.
    """
    return pack(cut_pieces(docs, tokenizer_path, end_id, capacity, doc_id, text), capacity)
