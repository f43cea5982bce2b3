"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt to shards and lined up there in a seeded order. Words are apportioned to sources by their
targets and to a source's shards by their words. A shard's words are cut into blocks of equal size (its last may be shorter),
a size between half of BLOCK_TOKENS and all of it that its share is nearly a multiple of; so the share is an integer quota,
and how a source is cut does not depend on the others. A quota of q among n blocks takes each block q div n times and q mod n
full blocks once more: those at equal steps from a seeded start. What a document gives follows from its place in its shard
alone, by integer arithmetic, so no block is ever a row.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import pick, release, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_TOKENS = 256
ROWS_PER_SHARD, MOST_SHARDS = 2_000, 10_000
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Each source's share of share x all sizes by weight; what exceeds most x its size goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out.update((s, left * weight[s] / total) for s in open_)
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), each party with `most` at most; ties go to the first.

    Nearly all seats are found by one divisor, so the work does not grow with their number.
    """
    def at(divisor: float) -> list[int]:
        return [min(m, int(v / divisor + 0.5)) for v, m in zip(votes, most)]

    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    if seats <= 0:
        return [0] * len(votes)
    low, high = 0.0, 4.0 * max(votes)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if middle and sum(at(middle)) <= seats else (middle, high)
    out = at(high)
    heap = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, out, most)) if v > 0 and s < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def block_of(rest: int, words: int, most: int = BLOCK_TOKENS) -> tuple[int, int]:
    """Block size and how many full blocks of a shard's `words` come nearest to `rest` words (fewer than all).

    A rest of one block's words or less is one block. Else the size is from half of `most` on, the largest of the nearest.
    """
    if rest <= most:
        return max(1, rest or min(most, words)), int(rest > 0)
    size = min(range(most, most // 2 - 1, -1), key=lambda b: abs(rest - min(round(rest / b), words // b) * b))
    return size, min(round(rest / size), words // size)


def quotas(
    shards: dict[tuple[str | None, int], int], target: dict[str | None, float], most: int = MOST, block_tokens: int = BLOCK_TOKENS,
) -> dict[tuple[str | None, int], tuple[int, int, int]]:
    """Each shard's block size, quota of blocks and number of blocks, from the words of all shards."""
    members: dict[str | None, list[int]] = {}
    for source, shard in shards:
        members.setdefault(source, []).append(shard)
    order = sorted(members, key=lambda s: (s is None, s or ""))
    words = {s: sum(shards[s, x] for x in members[s]) for s in order}
    shares = sainte_lague([target[s] for s in order], round(sum(target[s] for s in order)), [most * words[s] for s in order])
    out = {}
    for source, share in zip(order, shares):
        own = sorted(members[source])
        given = sainte_lague([float(shards[source, x]) for x in own], share, [most * shards[source, x] for x in own])
        for shard, n in zip(own, given):
            size = shards[source, shard]
            whole, rest = divmod(n, size) if size else (0, 0)
            block, more = block_of(rest, size, block_tokens)
            blocks = max(1, -(-size // block))
            out[source, shard] = block, whole * blocks + more, blocks
    return out


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers from 0 on."""
    return ((a - a % b) / b).cast("long")


def _before(place: Column) -> Column:
    """Words taken, repeats counted, before a place in a shard."""
    block, quota, blocks, phase = (F.col(c) for c in ("block", "quota", "blocks", "phase"))
    number, each = _div(place, block), quota % blocks
    extra, after = _div(number * each + phase, blocks), _div((number + 1) * each + phase, blocks)
    return _div(quota, blocks) * place + block * extra + (after - extra) * (place - block * number)


def plan_mix(
    rows: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """`rows`, a staged table with source, size and rank (a seeded number), with each row's place and what the mix takes.

    Adds source_size, target, taken and the shard's begin, block, quota, blocks, phase. The driver holds one row for each
    source and for each of at most MOST_SHARDS shards more; a source of a third of all rows has a third of the shards.
    """
    spark = rows.sparkSession
    stats = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    target = targets({s: n for s, (n, _) in stats.items()}, weights, share, most)
    per_shard = max(ROWS_PER_SHARD, sum(n for _, n in stats.values()) // MOST_SHARDS)
    sources = [(s, size, target[s], -(-n // per_shard)) for s, (size, n) in stats.items()]
    table = spark.createDataFrame(sources, "__source string, source_size bigint, target double, shards bigint")
    placed = rows.join(table, F.col("source").eqNullSafe(F.col("__source"))).withColumn("shard", F.pmod("rank", "shards")).drop("__source", "shards")
    words = {(r["source"], r["shard"]): r["size"] for r in placed.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect()}
    # a start not below the number of further blocks leaves the last block, which may be short, out of them
    shards = [(s, x, block, quota, blocks, quota % blocks + (seed * 1_000_003 + x * 7_919) % (blocks - quota % blocks))
              for (s, x), (block, quota, blocks) in quotas(words, target, most, block_tokens).items()]
    table = spark.createDataFrame(shards, "__source string, __shard bigint, block bigint, quota bigint, blocks bigint, phase bigint")
    line = Window.partitionBy("source", "shard").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))
    return lined.join(table, same).drop("__source", "__shard").withColumn(
        "taken", (_before(F.col("begin") + F.col("size")) - _before(F.col("begin"))).cast("long"))


def ranked(docs: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more: str) -> DataFrame:
    """Small rows for `plan_mix`: doc_id, source, size, rank and the columns `more` names. The text is read, not carried."""
    rows = pick(docs, doc_id=doc_id, text=text, source=source, **more)
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), rank.alias("rank"), *more)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    A null source is a source of its own, ordered last; null or empty texts have size 0 and give nothing. Order within a
    shard follows a hash of (seed, doc_id, text), so reruns agree; equal rows may stand in for each other. An empty table
    gives no rows; other columns are ignored. Small rows (no texts) are written to the shared folder first.
    """
    rows = staged(ranked(docs, seed, doc_id, text, source), "mix-rows")
    return plan_mix(rows, seed).select("doc_id", "size", "source_size", "target", "taken")


def copies(text: str, begin: int, block: int, quota: int, blocks: int, phase: int) -> list[str]:
    """The texts a document gives to the mix: whole ones, and one of the words in blocks that are taken once more."""
    whole, more = divmod(quota, blocks)
    spans = [m.span() for m in re.finditer(WORD, text)]
    out, runs, stop = [text] * whole if spans else [], [], begin + len(spans)
    for number in range(begin // block, -(-stop // block)) if more and spans else ():
        if ((number + 1) * more + phase) // blocks > (number * more + phase) // blocks:
            first, last = max(begin, number * block) - begin, min(stop, (number + 1) * block) - begin
            if runs and runs[-1][1] == first:
                runs[-1] = runs[-1][0], last
            else:
                runs.append((first, last))
    if runs == [(0, len(spans))]:
        out.append(text)
    elif runs:
        out.append("\n".join(text[spans[first][0]:spans[last - 1][1]] for first, last in runs))
    return out


def take(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """`docs` as the mix has them: a row for each copy of a document, its text the words that are taken.

    Columns stay as they are. Rows are numbered in a written copy of `docs`, and found again by that number.
    """
    names = docs.columns
    kept = staged(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    at = {n: f"c{names.index(n)}" for n in (doc_id, text, source)}
    rows = staged(ranked(kept, seed, at[doc_id], at[text], at[source], row="row"), "mix-rows")
    plan = plan_mix(rows, seed).where("taken > 0").select("row", "begin", "block", "quota", "blocks", "phase")
    content, schema = at[text], ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(c).to_pylist() for c in ("begin", "block", "quota", "blocks", "phase")]
            given = [copies(t, *p) for t, *p in zip(batch.column(content).to_pylist(), *places)]
            index = pa.array([i for i, texts in enumerate(given) for _ in texts], pa.int64())
            new = batch.select([f"c{i}" for i in range(len(names))]).take(index)
            column = new.schema.get_field_index(content)
            yield new.set_column(column, content, pa.array([t for texts in given for t in texts], batch.schema.field(content).type))
        release()

    return kept.join(plan, "row").mapInArrow(cut, schema).toDF(*names)
