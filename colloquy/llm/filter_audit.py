"""Filter interaction audit by count-weighted decision diagrams.

Every document has a failure mask, one bit for each filter. Per part, the counts of the masks make a decision diagram: a
level for each filter, a pass and a fail edge, and at every node the number of documents below it. Swapping two adjacent
levels rewrites only the nodes of these two, so walking through all orders by adjacent swaps takes one small step for
each. In an order's diagram the path of passes shows the steps: what leaves it by a fail edge is removed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import pick, staged

FILTERS = "ABCDE"
WHITE, WHITE_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
STEPS = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
Weight = tuple[int, int, int]  # documents, good ones, toxic ones


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that is not null: few words, few different words, capitals, symbols."""
    inner = F.btrim(text, F.lit(WHITE_CHARS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE))
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by failure mask (bit i: the i-th of FILTERS), a row for each mask that occurs.

    Small rows (no texts) are written to the shared folder first. Equal texts meet by their SHA-256; only texts of several
    ids are joined back. A null text is empty, a null source is the part of the empty name. A null id is neither smaller nor
    larger than another. A document is good or toxic when any label row of its id says 1; labels of a null id are of none.
    """
    rows = pick(docs, doc_id=doc_id, text=text, source=source)
    body = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_failures(body))]
    slim = staged(rows.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), sum(bits[1:], bits[0]).cast("int").alias("mask"),
        F.unhex(F.sha2(body, 256)).alias("digest")), "audit-rows")
    several = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = staged(several.select("digest", "first"), "audit-copies")
    signs = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    fails_e = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    whole = slim.join(copies, "digest", "left").withColumn("mask", F.col("mask") + fails_e).select("doc_id", "part", "mask")
    return whole.join(signs, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


class Diagram:
    """A decision diagram over masks; nodes are shared within a level, and no level is skipped, so counts add up."""

    def __init__(self, order: str, weights: dict[int, Weight], names: str = FILTERS):
        self.order = list(order)
        bit = {name: 1 << i for i, name in enumerate(names)}
        self.edges: list[tuple[int, int] | None] = []
        self.weight: list[Weight] = []
        shared: dict[tuple[int, ...], int] = {}

        def build(depth: int, mask: int) -> int:
            if depth == len(self.order):
                return self._node(shared, weights.get(mask, (0, 0, 0)), None)
            passes, fails = build(depth + 1, mask), build(depth + 1, mask | bit[self.order[depth]])
            return self._node(shared, self._sum(passes, fails), (passes, fails))

        self.root = build(0, 0)

    def _sum(self, passes: int, fails: int) -> Weight:
        return tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails]))

    def _node(self, shared: dict, weight: Weight, edges: tuple[int, int] | None) -> int:
        """The node with these edges (an end: with this weight), new if there is none among `shared`."""
        key = edges or weight
        if key not in shared:
            shared[key] = len(self.edges)
            self.edges.append(edges)
            self.weight.append(weight)
        return shared[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next. Nodes above keep their edges, nodes below their place."""
        upper = {self.root}
        for _ in range(level):
            upper = {child for node in upper for child in self.edges[node]}
        shared: dict[tuple[int, ...], int] = {}
        for node in upper:
            (pass_pass, pass_fail), (fail_pass, fail_fail) = (self.edges[child] for child in self.edges[node])
            both = (pass_pass, fail_pass), (pass_fail, fail_fail)
            self.edges[node] = tuple(self._node(shared, self._sum(*edges), edges) for edges in both)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> Iterator[tuple[str, Weight, Weight]]:
        """(filter, what it keeps, what it removes) along the path of passes."""
        node = self.root
        for name in self.order:
            node, fails = self.edges[node]
            yield name, self.weight[node], self.weight[fails]


def plain_changes(n: int) -> Iterator[int]:
    """Places (each with its next one) to swap so that n things pass through all their orders."""
    if n < 2:
        return
    down = True
    for inner in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + down
        down = not down


def audit_part(weights: dict[int, Weight], names: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    A filter's failures are what it removes where it comes first; failures of it alone, what it removes where it comes last.
    """
    diagram, paths = Diagram(names, weights, names), {}
    for change in [None, *plain_changes(len(names))]:
        if change is not None:
            diagram.swap(change)
        paths["".join(diagram.order)] = list(diagram.all_pass_path())
    fails, alone, shapley = {}, {}, dict.fromkeys(names, 0)
    for path in paths.values():
        fails[path[0][0]], alone[path[-1][0]] = path[0][2][0], path[-1][2][0]
        for name, _, removed in path:
            shapley[name] += removed[0]
    return [
        (order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for order, path in paths.items() for step, (name, kept, removed) in enumerate(path, 1)
    ]


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every part's steps in every order of the filters, zeros included.

    A part has at most 2^filters rows of `masks`, so its diagram is bounded however many documents it counts; keep to six
    filters or so, for their orders are all listed. An empty table gives no rows.
    """
    def one_part(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {int(m): (int(n), int(good), int(toxic)) for m, n, good, toxic in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        return pd.DataFrame([(rows["part"].iloc[0], *step) for step in audit_part(weights, names)], columns=[c.split()[0] for c in STEPS.split(", ")])

    return masks.groupBy("part").applyInPandas(one_part, STEPS)
