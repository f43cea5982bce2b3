"""Near-duplicate detection: BagMinHash signatures over word shingles, bands, and verified multiset overlap.

Equal texts are one node. Nodes that share a band are candidates. Each band's nodes are compared with its smallest node
first; links found join nodes into components. Only in bands that still hold several components are the rest compared,
across components, in blocks of bounded size inside tasks. So every pair of candidates is either compared or already
joined, and no group is ever written out in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import shingles
from colloquy.llm.common import pick, release, staged

THRESHOLD = 0.8
#: 30 bands of 5: a pair at the threshold shares none with probability 7e-6.
BANDS, ROWS = 30, 5
#: Members of a band compared in one task at once, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key (digest of the text) and band keys (none for a text without words) of every row."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for at, words, count in shingles.words_of(batch.column("text")):
                bag = shingles.multisets(words, count)
                found = shingles.band_keys(shingles.bag_min_hash(*bag, len(count), bands * rows), bands)
                lists = [own.tolist() if n else [] for own, n in zip(found, count)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(count)), keys.slice(at, len(count)), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])
        release()

    return docs.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, bands array<bigint>")


def _elements(texts: DataFrame) -> DataFrame:
    """node, its multiset's elements as raw unsigned 64-bit numbers in order, and their number."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, count in shingles.words_of(batch.column("text")):
                own = shingles.elements(*shingles.multisets(words, count), len(count))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(at, len(count)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())],
                    ["node", "elements", "size"])
        release()

    return texts.select("node", "text").mapInArrow(collect, "node bigint, elements binary, size bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of `links` (a, b).

    Each round takes the least component among neighbours, then that component's own; labels are a written table.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = staged(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "components")
        upper = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        after = staged(lower.join(upper, "component").select("node", "was", F.col("top").alias("component")), "components")
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels


def _verified(pairs: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
            good = [shingles.similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    both = pairs.join(contents.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
    both = both.join(contents.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a")
    near = F.octet_length("left") * threshold <= F.octet_length("right")
    return both.where(near & (F.octet_length("right") * threshold <= F.octet_length("left"))).select("a", "b", "left", "right").mapInArrow(check, "a bigint, b bigint")


def _across(members: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """Links between members (bucket, node, component, of) of a bucket that are in different components.

    A bucket's members are dealt to `of` blocks; each pair of blocks is one group of bounded size.
    """
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "node"])
        nodes, blocks, top = (group[c].to_numpy() for c in ("node", "block", "component"))
        size, links = group["size"].to_numpy(), []
        left, right = blocks == group["i"].iloc[0], blocks == group["j"].iloc[0]
        both = shingles.overlaps([np.frombuffer(x, np.uint64) for x in group["elements"]], left, right)
        near = both >= threshold * (size[left][:, None] + size[right][None, :] - both)
        top, names = top.copy(), np.flatnonzero(right)
        for x, row in zip(np.flatnonzero(left), near):
            others = names[row]
            for y in others[np.unique(top[others], return_index=True)[1]] if len(others) else ():
                if top[y] != top[x]:
                    links.append((nodes[x], nodes[y]))
                    top[top == top[y]] = top[x]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    spread = dealt.withColumn("pair", F.explode(meets)).select("bucket", "node", "component", "block", "pair.i", "pair.j")
    return spread.join(contents, "node").groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, kept (one row of each class) for every row.

    A class is a connected group of texts whose multisets of five-word shingles have weighted Jaccard `threshold` or more.
    Null texts equal empty ones; a text without words is only in the class of its equals. Null ids come last in the choice
    of the row that stays; of equal rows one stays. An empty table gives none; other columns are ignored. Several jobs run
    when this is called; what they pass on is written to the shared folder.
    """
    source = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = source.withColumn("key", F.unhex(F.md5("text")))
    signed = staged(_signed(keyed, bands, rows), "signatures")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = staged(
        signed.groupBy("key").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = staged(spread.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = staged(spread.join(buckets, "bucket"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    contents = staged(_elements(keyed.dropDuplicates(["key"]).join(wanted, "key")), "contents")
    stars = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = staged(_verified(stars, contents, threshold), "links")
    joined = components(links)
    # Both are tables of their own, so that the join may split a bucket that very many members share.
    placed = members.where("n > 2").join(joined, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = staged(placed, "placed")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    mixed = placed.join(contents.select("node", "size"), "node").groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), blocks.alias("of")).where("low <> high").select("bucket", "of")
    mixed = staged(mixed, "mixed")
    more = staged(_across(placed.join(mixed, "bucket"), contents, threshold), "links")
    if not more.isEmpty():
        joined = components(links.union(more))
    grouped = staged(nodes.join(joined, "node", "left").select("node", "key", "best", "n", F.coalesce("component", "node").alias("component")), "grouped")
    classes = grouped.groupBy("component").agg(F.min("best").alias("keeper"), F.sum("n").alias("class_size"))
    by_key = grouped.select("key", "component").join(classes, "component").select("key", "keeper", "class_size")
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("doc_id"))
    out = signed.select("doc_id", "key").withColumn("nth", nth).join(by_key, "key")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key")) & (F.col("nth") == 1)
    return out.select("doc_id", F.col("keeper.doc_id").alias("class_id"), "class_size", kept.alias("kept"), "key")
