"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import n_buckets, pick, running_sum, staged

ROUNDS = 4
#: Movers into a shard are admitted by classes of their neighbour's degree (powers of two), each in so many hash steps.
STEPS = 64
#: A shard may grow by this part above its capacity while rows move: where nearly all rows are linked, room there is none else.
SLACK = 0.01
#: Documents above this share of a shard are placed before the others, which then even out what those left uneven.
BIG = 1 / 200
#: Groups of equal texts above this share of a shard are placed whole before all others, over no more shards than they need.
LARGE = 1 / 16


def _votes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """For each linked node: its shard, votes for it, the shard with most votes and those, the least degree among voters there."""
    other = labels.select(F.col("id").alias("b"), F.col("shard").alias("to"), F.col("degree").alias("of"))
    counted = links.join(other, "b").groupBy(F.col("a").alias("id"), "to").agg(F.count(F.lit(1)).alias("n"), F.min("of").alias("of"), F.min("b").alias("low"))
    own = labels.select("id", "shard", "size")
    by_node = counted.join(own, "id").groupBy("id", "shard", "size").agg(
        F.max(F.struct("n", (F.col("to") == F.col("shard")).alias("stay"), (-F.col("to")).alias("minus"), "of")).alias("best"),
        F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("n"))), F.lit(0)).alias("here"), F.min("low").alias("low"),
    )
    return by_node.select("id", "shard", "size", "here", "low", (-F.col("best.minus")).alias("to"), F.col("best.n").alias("there"), F.col("best.of").alias("of"))


def admitted(flows: list[tuple[int, int, int, int]], held: dict[int, int], capacity: float) -> dict[int, int]:
    """The last step of movers that each shard takes (-1: none), for flows (from, to, step, bytes).

    What leaves a shard makes room there: first all are taken, then shards that would hold more than `capacity` take fewer,
    which may leave others with more, until all hold.
    """
    cuts = {s: max((step for _, to, step, _ in flows if to == s), default=-1) for s in held}
    while True:
        room = {s: capacity - held[s] for s in held}
        coming: dict[int, dict[int, int]] = {s: {} for s in held}
        for start, to, step, size in flows:
            if step <= cuts[to]:
                room[start] += size
                coming[to][step] = coming[to].get(step, 0) + size
        fewer = {}
        for s, steps in coming.items():
            last = -1
            for step in sorted(steps):
                room[s] -= steps[step]
                if room[s] < 0:
                    break
                last = step
            fewer[s] = last
        if fewer == cuts:
            return cuts
        cuts = fewer


def propagate(
    labels: DataFrame, links: DataFrame, capacity: int, n_shards: int, rounds: int = ROUNDS, taken: dict[int, float] | None = None,
) -> DataFrame:
    """New shards of `labels` (id, size, shard, degree; linked nodes only) and whether a neighbour shares them.

    `links` has both directions (a, b). In the first round nodes that have a smaller neighbour may move, so groups gather at
    their smallest; in each later round half of the nodes, drawn by hash, so that neighbours do not keep changing places. A shard takes movers, small groups' first, while its bytes, less those of
    its leavers, stay within `capacity` (and SLACK), of which `taken` is in use by others; sums by shards, class and hash step (bounded) come to the driver and go back as cut-offs. Each round's
    labels are a written table. Ends early when two rounds in a row moved nothing.
    """
    spark, quiet = labels.sparkSession, 0
    for turn in range(rounds):
        votes = _votes(labels, links)
        free = F.pmod(F.xxhash64("id", F.lit(-turn)), F.lit(2)) == 0 if turn else F.col("low") < F.col("id")
        wishes = votes.where((F.col("there") > F.col("here")) & free)
        step = F.floor(F.log2("of")).cast("int") * STEPS + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(STEPS)).cast("int")
        wishes = staged(wishes.select("id", F.col("shard").alias("from"), "to", "size", step.alias("step")), "moves")
        held = dict.fromkeys(range(n_shards), 0) | (taken or {})
        for r in labels.groupBy("shard").agg(F.sum("size").alias("size")).collect():
            held[r["shard"]] += r["size"]
        flows = [tuple(r) for r in wishes.groupBy("from", "to", "step").agg(F.sum("size")).collect()]
        cuts = admitted(flows, held, capacity * (1 + SLACK))
        quiet = quiet + 1 if max(cuts.values()) < 0 else 0
        if quiet == 2 or (quiet and rounds - turn == 1):
            break
        if not quiet:
            cut = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("to"))
            moved = wishes.where(F.col("step") <= cut).select("id", "to")
            labels = staged(labels.join(moved, "id", "left").select("id", "size", F.coalesce("to", "shard").alias("shard"), "degree"), "labels")
    return _votes(labels, links).select("id", "size", "shard", (F.col("here") > 0).alias("settled"))


def _fill(rows: DataFrame, room: list[float], n_shards: int, rows_total: int) -> DataFrame:
    """Deal staged `rows` (row, size, ...) to shards in proportion to their room, in hash order; adds shard."""
    free = [max(0.0, r) for r in room]
    if not sum(free):
        free = [1.0] * n_shards
    total = rows.agg(F.sum("size")).first()[0] or 0
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets(rows_total))))
    lined = running_sum(dealt, [], "__bucket", [F.col("row")], F.col("size"), "__place").drop("__bucket")
    ends, at = [], 0.0
    for r in free[:-1]:
        at += r / sum(free) * total
        ends.append(at)
    middle = F.col("__place") + F.col("size") / 2
    shard = sum(((middle >= F.lit(e)).cast("int") for e in ends), F.lit(0))
    return lined.withColumn("shard", shard).drop("__place")


def allot(sizes: list[int], n_shards: int, share: float) -> list[list[tuple[int, float]]]:
    """For groups, largest first: (shard, bytes) parts; a group is split only if no shard has room for it."""
    room, out = [share] * n_shards, []
    for size in sizes:
        rest, parts = float(size), []
        while rest > 0:
            shard = max(range(n_shards), key=lambda s: (room[s], -s))
            part = min(rest, room[shard]) if room[shard] >= 1 else rest
            room[shard] -= part
            rest -= part
            parts.append((shard, part))
        out.append(parts)
    return out


def place_groups(nodes: DataFrame, groups: list[tuple[bytes, int]], n_shards: int, share: float, rows_total: int) -> DataFrame:
    """row, shard of the staged `nodes` (row, size, group) in `groups` (group, bytes; largest first, bounded), in hash order."""
    parts = [(g, [sum(n for _, n in p[:i + 1]) for i in range(len(p) - 1)], [s for s, _ in p])
             for (g, _), p in zip(groups, allot([n for _, n in groups], n_shards, share))]
    plan = nodes.sparkSession.createDataFrame(parts, "group binary, ends array<double>, shards array<int>")
    own = nodes.join(F.broadcast(plan), "group").withColumn("__bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets(rows_total))))
    lined = running_sum(staged(own, "large"), ["group"], "__bucket", [F.col("row")], F.col("size"), "__place")
    middle = F.col("__place") + F.col("size") / 2
    return lined.select("row", F.element_at("shards", F.size(F.filter("ends", lambda e: e <= middle)) + 1).alias("shard"))


def shard_linked(nodes: DataFrame, links: DataFrame, n_shards: int = 16, rounds: int = ROUNDS, fixed: DataFrame | None = None) -> DataFrame:
    """`nodes` (a staged table: unique `row`, `size`, more) with `shard` and a gapless `slot` in it; bytes near equal.

    `links` are pairs (a, b) of rows, each once. Rows of `fixed` (a staged table: row, shard; without links) stay there. Linked nodes
    are placed by propagation from a hash, over shards in proportion to the room there; then those without a link, or
    without a neighbour in their shard, fill the shards up evenly, large ones first.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    degrees = both.groupBy(F.col("a").alias("row")).agg(F.count(F.lit(1)).alias("degree"))
    first = F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")
    total, count = nodes.agg(F.sum("size"), F.count(F.lit(1))).first()
    share = (total or 0) / n_shards
    taken = {r["shard"]: r["size"] for r in nodes.join(fixed, "row").groupBy("shard").agg(F.sum("size").alias("size")).collect()} if fixed is not None else {}
    room = [max(0.0, share - taken.get(i, 0)) for i in range(n_shards)]
    if taken and sum(room):
        drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20)
        first = sum(((drawn >= F.lit(sum(room[:i + 1]) / sum(room))).cast("int") for i in range(n_shards - 1)), F.lit(0))
    linked = nodes.join(degrees, "row").select(F.col("row").alias("id"), "size", first.alias("shard"), "degree")
    placed = propagate(staged(linked, "labels"), both, int(share), n_shards, rounds, taken)
    settled = placed.where("settled").select(F.col("id").alias("row"), "shard")
    settled = staged(settled.union(fixed.select("row", "shard")) if fixed is not None else settled, "settled")
    held = [0.0] * n_shards
    known = nodes.join(settled, "row")
    for r in known.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        held[r["shard"]] = float(r["size"])
    free = staged(nodes.join(settled, "row", "left_anti"), "free")
    big = staged(_fill(free.where(F.col("size") > share * BIG), [share - h for h in held], n_shards, count), "big")
    for r in big.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        held[r["shard"]] += r["size"]
    small = _fill(free.where(F.col("size") <= share * BIG), [share - h for h in held], n_shards, count)
    names = [*nodes.columns, "shard"]
    out = staged(known.select(names).union(big.select(names)).union(small.select(names)), "sharded")
    dealt = out.withColumn("__bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets(count))))
    return running_sum(dealt, ["shard"], "__bucket", [F.col("row")], F.lit(1), "slot").drop("__bucket")


def shard_documents(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; equal texts are linked (each to its group's first row).

    Law `bytes`: shards' sizes (UTF-8 bytes plus 1) are near equal; a group larger than a shard spreads over as many as it
    needs: groups above a sixteenth of a shard are placed first, on the driver's plan (at most 16 a shard). Null texts have size 1 and the checksum of no bytes. Rows with equal or null ids are rows of their own; an empty table gives
    none; other columns are ignored. Only small rows (no texts) are written and shuffled.
    """
    content = F.coalesce("text", F.lit(""))
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
        F.unhex(F.md5(content)).alias("group"), F.monotonically_increasing_id().alias("row"),
    )
    nodes = staged(rows, "shard-rows")
    # As a table of its own, so that the join may split a group that a third of the rows are in.
    hubs = staged(nodes.groupBy("group").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "hubs")
    total, count = nodes.agg(F.sum("size"), F.count(F.lit(1))).first()
    share = (total or 0) / n_shards
    large = F.col("bytes") > share * LARGE
    groups = sorted(((r["group"], r["bytes"]) for r in hubs.where(large).select("group", "bytes").collect()), key=lambda g: (-g[1], g[0]))
    fixed = staged(place_groups(nodes, groups, n_shards, share, count), "placed") if groups else None
    links = nodes.join(hubs.where(~large), "group").where("row <> a").select("a", F.col("row").alias("b"))
    out = shard_linked(nodes.drop("group"), links, n_shards, rounds, fixed)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
