"""Merkle manifest of a dataset: a hash tree over documents, proofs and their check by a recursive query.

Leaves are placed in their language by id. Blocks of 4,096 consecutive nodes are hashed up twelve levels in one task, their
tops make the next round's nodes, so a tree takes as many rounds as its depth has dozens. What is built is stored as rows:
a node with its link to the ancestor HOP levels up (or the top) and the siblings on the way there; only nodes of every
HOP-th level have rows. A recursive query climbs from every leaf at once: each step joins the nodes reached with their rows,
appends the siblings and folds the hash with them.

A node high up is reached from very many leaves. Its row is stored once for each block below it, and block and node are
the key together: no key has more than 4,096 leaves, and that adds a row per block and level only.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Scratch, pick, running_sum

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are built in one task.
LEVELS = 12
#: Levels climbed in one step of the query, a divisor of LEVELS.
HOP = 12
EVERY = 7
ROWS_PER_RANGE = 100_000
#: `path`: for each level climbed L or R (the side of the node that climbs) and the sibling's digest; N for a node alone.
LINK = ["tree", "block", "level", "place", "to_level", "up", "path"]
NODE = "tree bigint, block bigint, level int, place bigint, to_level int, up bigint, path array<binary>, digest binary, top boolean"


def field(value: Column) -> Column:
    """A value as the hash reads it: bytes, colon, value; a minus for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def join_hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _placed(rows: DataFrame, groups: list[str], order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """`rows` (a written table) with `place`: each row's number from 0 in its group and order. No group gathers in one task."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    dealt = scratch.table(rows.repartitionByRange(ranges, *groups, *order).withColumn("range", F.spark_partition_id()), name)
    return running_sum(dealt, groups, "range", [F.col(c) for c in order], F.lit(1), "place").drop("range")


def _step(digests: list[bytes], i: int) -> bytes:
    """What the `i`-th node meets on its way one level up."""
    sibling = digests[i ^ 1:(i ^ 1) + 1]
    return (b"R" if i % 2 else b"L") + sibling[0] if sibling else b"N"


def _climbed(nodes: DataFrame, base: int) -> DataFrame:
    """The rows of one round: `nodes` has tree, place, digest and n, the number of nodes of the tree at level `base`."""
    levels, hop = LEVELS, HOP

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree, n, first = int(rows["tree"].iloc[0]), int(rows["n"].iloc[0]), int(rows["place"].iloc[0])
        number, built = first >> levels, [list(rows["digest"])]
        while n > 1 and len(built) <= levels:
            built.append([join_hash(built[-1][i:i + 2]) for i in range(0, len(built[-1]), 2)])
            n = (n + 1) >> 1
        high, out = len(built) - 1, []
        for low in range(0, high, hop):
            to = min(low + hop, high)
            for i in range(len(built[low])):
                path = [_step(built[k], i >> (k - low)) for k in range(low, to)]
                place = (first >> low) + i
                out.append((tree, number, base + low, place, base + to, place >> (to - low), path, None, False))
        out.append((tree, number, base + high, first >> high, None, None, None, built[-1][0], n == 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")]).astype({"up": "Int64", "to_level": "Int32"})

    return nodes.groupBy("tree", F.shiftright("place", levels).alias("block")).applyInPandas(block, NODE)


def _built(leaves: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes below their tree's top, tops) of all trees from their leaves: tree, place, digest, n.

    `block` of a node is its number among the round's blocks. Tops are tree, level, digest.
    """
    base, nodes, tops = 0, None, None
    while True:
        round_ = scratch.table(_climbed(leaves, base), f"{name}-{base}")
        own, done = round_.where("digest is null").drop("digest", "top"), round_.where("top").select("tree", "level", "digest")
        own = own.withColumn("base", F.lit(base))
        nodes, tops = (own, done) if nodes is None else (nodes.union(own), tops.union(done))
        rest = round_.where("digest is not null and not top")
        if rest.isEmpty():
            return nodes, tops
        sizes = rest.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        base, leaves = base + LEVELS, rest.select("tree", "place", "digest").join(sizes, "tree")


def _above(nodes: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """The links that the leaves of each of `blocks` (tree, block) pass from level LEVELS on."""
    steps = blocks.where(F.lit(height > LEVELS)).withColumn("level", F.explode(F.sequence(F.lit(LEVELS), F.lit(max(LEVELS, height - 1)), F.lit(HOP))))
    steps = steps.withColumn("place", F.expr(f"shiftright(block, level - {LEVELS})"))
    return steps.join(nodes.where("base > 0").drop("block", "base"), ["tree", "level", "place"]).select(LINK)


FOLD = """aggregate({path}, {start}, (x, s) -> unhex(sha2(CASE WHEN substring(s, 1, 1) = X'52' THEN lower(concat(hex(substring(s, 2)), hex(x)))
      ELSE lower(concat(hex(x), hex(substring(s, 2)))) END, 256)))"""
#: {{leaves}} starts with the siblings of its first hop; {{nodes}} has the rows of all nodes above.
CLIMB = f"""
WITH RECURSIVE climb (row, tree, block, level, place, path, folded) AS (
  SELECT row, tree, block, to_level, up, path, {FOLD.format(path="path", start="folded")} FROM {{leaves}}
  UNION ALL
  SELECT c.row, c.tree, c.block, n.to_level, n.up, n.path, {FOLD.format(path="n.path", start="c.folded")}
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.block = n.block AND c.level = n.level AND c.place = n.place)
SELECT row, sha2(lower(concat_ws('', transform(flatten(transform(array_sort(collect_list(struct(level, path))), x -> x.path)), s -> hex(substring(s, 2))))), 256)
    AS proof_sha256, lower(hex(max_by(folded, level))) AS folded_root
FROM climb GROUP BY row"""


def manifest(docs: DataFrame, every: int = EVERY, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    `fields` are the columns that a leaf hashes, in this order; they hold doc_id, lang and n_chars. Leaves of a language
    (null is one) ascend by doc_id, null first, equal ids by their hash. Subroots make the upper tree by language, null
    first. Rows whose id's CRC-32 `every` divides are folded from a leaf with n_chars + 1; a null id or n_chars is not
    tampered with, so such a row verifies. Equal rows are leaves of their own. A lone document is its subroot and root,
    with an empty proof. An empty table gives no rows; other columns are ignored.

    Runs jobs at once: rows of some hundred bytes are written to the shared folder, never texts.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rows = pick(docs, **{f: f for f in fields})
    values = [F.col(f) for f in fields]
    changed = [(F.col(f).cast("decimal(38,0)") + 1) if f == "n_chars" else F.col(f) for f in fields]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0) & F.col("n_chars").isNotNull()
    scratch = Scratch(spark, "merkle")
    hashed = scratch.table(rows.select(
        "doc_id", "lang", leaf_hash(*values).alias("leaf"), F.when(hit, leaf_hash(*changed)).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "hashed")
    sizes = scratch.table(hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    trees = scratch.table(_placed(sizes, [], ["lang"], scratch, "languages").withColumnRenamed("place", "tree"), "trees")
    placed = _placed(hashed, ["lang"], ["doc_id", "leaf", "row"], scratch, "order").withColumnRenamed("lang", "own")
    leaves = scratch.table(placed.join(trees, F.col("own").eqNullSafe(F.col("lang"))).select(
        "row", "doc_id", "tree", "place", F.col("leaf").alias("digest"), "tampered", "n", F.shiftright("place", LEVELS).alias("block")), "leaves")
    for name in ("hashed", "sizes", "languages", "order"):
        scratch.drop(name)
    nodes, subroots = _built(leaves.select("tree", "place", "digest", "n"), scratch, "levels")
    subroots = scratch.table(subroots, "subroots")
    count = subroots.count()
    if not count:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    upper, top = _built(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(count).cast("long").alias("n")), scratch, "upper")
    root = top.first()["digest"].hex()
    heights = subroots.select("tree", F.col("level").alias("height"))
    blocks = leaves.select("tree", "block").distinct()
    height = heights.agg(F.max("height")).first()[0]
    own = nodes.where("base = 0").select(LINK).union(_above(nodes, blocks, height))
    # the top level of a language's tree is the lowest of the upper one, at the place that is the language's number
    own = own.join(heights, "tree").withColumn("up", F.when(F.col("to_level") == F.col("height"), F.col("tree")).otherwise(F.col("up"))).select(LINK)
    upper_height = top.first()["level"]
    if upper_height:
        steps = blocks.join(heights, "tree").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(upper_height - 1), F.lit(HOP))))
        steps = steps.withColumn("at", F.expr("shiftright(tree, step)"))
        over = upper.select(F.col("level").alias("step"), F.col("place").alias("at"), "to_level", "up", "path")
        own = own.union(steps.join(over, ["step", "at"]).select(
            "tree", "block", (F.col("height") + F.col("step")).cast("int"), "at", (F.col("height") + F.col("to_level")).cast("int"), "up", "path"))
    stored = scratch.table(own, "nodes")
    # the first hop needs a leaf's own row, nearly all rows there are; a leaf without one is the only leaf of all
    start = F.when(F.col("height") == 0, F.col("tree")).otherwise(F.col("place"))
    low = stored.where("level = 0").select("tree", "block", F.col("place").alias("at"), "to_level", "up", "path")
    begun = leaves.join(heights, "tree").select("row", "tree", "block", start.alias("at"), F.coalesce("tampered", "digest").alias("folded"))
    begun = begun.join(low, ["tree", "block", "at"], "left").withColumns({
        "path": F.coalesce("path", F.array().cast("array<binary>")), "to_level": F.coalesce("to_level", F.lit(0))})
    climbed = spark.sql(CLIMB, leaves=begun, nodes=stored.where("level > 0"))
    out = leaves.select("row", "doc_id", "tree", F.lower(F.hex("digest")).alias("leaf")).join(climbed, "row").join(
        subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")), "tree")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
