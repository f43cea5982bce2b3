"""Finding many search terms in many texts.

Three ways give exactly the rows a substring test gives, for the same terms (blank ones are left out):

- a short list becomes one expression evaluated while the table is scanned: no join, no shuffle;
- a list or table of terms that is small, which is checked, goes to the tasks: a few dozen as an array that is filtered for
  each text, without Python; more as an automaton that each text goes through;
- a larger table stays distributed: every term is filed under its anchor, the four characters of it that are rarest in
  texts, texts under those of their characters that may be anchors, and the candidates of the join are tested.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import listed_rows

INLINE_TERMS = 32
#: Terms that Spark's own substring test looks for one by one, at most; more go to Python workers as an automaton.
LISTED_TERMS = 64
#: Characters of terms sent to the tasks, at most.
SLICE_CHARS = 8_000_000
#: Characters of an anchor; shorter terms are their own.
GRAM = 4
#: Texts looked at to see which anchors are rare, and counters for them; bits that tell possible anchors.
RARITY_TEXTS, RARITY_SLOTS, FILTER_BITS = 1_000, 1 << 16, 1 << 24
#: Words of 64 bits that tell possible tokens of names.
TOKEN_WORDS = 4_096

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def _hit(texts: list[Column], term: str, wildcards: bool) -> Column:
    if wildcards:
        tests = [t.ilike(f"%{term}%") for t in texts]
    else:
        tests = [t.contains(F.lower(F.lit(term))) for t in texts]
    out = F.coalesce(tests[0], F.lit(False))
    for test in tests[1:]:
        out = out | F.coalesce(test, F.lit(False))
    return out


def match_terms(
    df: DataFrame,
    columns: Sequence[str],
    terms: Sequence[str] | DataFrame,
    term_col: str = "topic",
    wildcards: bool = False,
    key: str | None = None,
) -> DataFrame:
    """One row per (row, term) whose term occurs, ignoring case, in any of the columns.

    `terms` is a list, or a DataFrame whose first column holds the terms; null and empty terms match nothing. With
    `wildcards` the characters % and _ of a listed term keep their pattern meaning. A table's size is looked at when the
    function is called. `key` names the row's identity for the reader and is not needed to match.
    """
    if not isinstance(terms, DataFrame):
        terms = [t for t in dict.fromkeys(terms) if t]
        if len(terms) <= INLINE_TERMS or wildcards:
            return _match_inline(df, columns, terms, term_col, wildcards)
        terms = listed_rows(df.sparkSession, [(t,) for t in terms], f"{term_col} string")
    if wildcards:
        raise ValueError("wildcard terms must be given as a list")
    needles = (
        terms.select(F.col(terms.columns[0]).alias(term_col))
        .where(F.length(term_col) > 0)
        .distinct()
        .withColumn("_needle", F.lower(term_col))
    )
    chars = needles.agg(F.sum(F.length(term_col) + F.length("_needle"))).first()[0]
    if chars is None:
        return df.withColumn(term_col, F.lit("")).limit(0)
    if chars > SLICE_CHARS:
        return _match_by_anchors(df, columns, needles, term_col)
    listed = [tuple(r) for r in needles.collect()]
    return (_match_listed if len(listed) <= LISTED_TERMS else _match_by_automaton)(df, columns, listed, term_col)


def _match_inline(
    df: DataFrame, columns: Sequence[str], terms: list[str], term_col: str, wildcards: bool
) -> DataFrame:
    texts = [F.col(c) if wildcards else F.lower(c) for c in columns]
    if not terms:
        return df.withColumn(term_col, F.lit("")).limit(0)
    if len(terms) == 1:
        return df.where(_hit(texts, terms[0], wildcards)).withColumn(term_col, F.lit(terms[0]))
    hits = F.array_compact(F.array(*[F.when(_hit(texts, t, wildcards), F.lit(t)) for t in terms]))
    return df.withColumn(term_col, F.explode(hits))


def _joined_text(columns: Sequence[str]) -> Column:
    """The searched columns in lower case as one text; the separator occurs in no term."""
    return F.lower(F.concat_ws("\u0000", *[F.col(c) for c in columns]))


def _match_listed(df: DataFrame, columns: Sequence[str], terms: list[tuple[str, str]], term_col: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(term).alias("term"), F.lit(needle).alias("needle")) for term, needle in terms])
    # as an element of an array the text is made once, not once for each term
    hits = F.transform(F.array(_joined_text(columns)), lambda text: F.filter(listed, lambda t: F.contains(text, t["needle"])))
    return df.withColumn(term_col, F.explode(F.transform(hits[0], lambda t: t["term"])))


def _match_by_automaton(
    df: DataFrame, columns: Sequence[str], terms: list[tuple[str, str]], term_col: str
) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Imported here: the function travels to workers that need not have this package.
        from ahocorasick import Automaton

        automaton = Automaton()
        by_needle: dict[str, list[str]] = {}
        for term, needle in shared.value:
            by_needle.setdefault(needle, []).append(term)
        for needle, originals in by_needle.items():
            automaton.add_word(needle, originals)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch:
                hits: dict[str, None] = {}
                for _, originals in automaton.iter(text) if text and by_needle else ():
                    hits.update(dict.fromkeys(originals))
                out.append(list(hits))
            yield pd.Series(out, dtype=object)

    return df.withColumn("_hits", found(_joined_text(columns))).withColumn(term_col, F.explode("_hits")).drop("_hits")


def _grams(text: str, n: int) -> np.ndarray:
    """Hashes of all runs of `n` characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ points[i:len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _rarity(texts: DataFrame) -> np.ndarray:
    """In how many of some texts (any RARITY_TEXTS at most) anchors occur, by slot. It decides on speed only."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.unique(_grams(t, GRAM) % np.uint64(RARITY_SLOTS)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots or [np.zeros(0, np.uint64)]).astype(np.int32))], ["slot"])

    seen = texts.limit(RARITY_TEXTS).mapInArrow(count, "slot int").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(RARITY_SLOTS, np.int64)
    for r in seen:
        out[r["slot"]] = r["n"]
    return out


def _match_by_anchors(df: DataFrame, columns: Sequence[str], needles: DataFrame, term_col: str) -> DataFrame:
    """Rows and terms joined by anchors; rows are known by two hashes of all their columns while texts stay behind.

    To the tasks go tables of fixed size: how rare anchors are, and bits that tell which runs of characters may be anchors.
    An anchor that very many rows or terms share is split by the join.
    """
    spark, text = df.sparkSession, _joined_text(columns)
    every = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.withColumn("_k1", F.xxhash64(F.lit(1), *every)).withColumn("_k2", F.xxhash64(F.lit(2), *every)).withColumn("_text", text)
    rarity = spark.sparkContext.broadcast(_rarity(df.select(text)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = []
            for needle in batch.column("_needle").to_pylist():
                grams = _grams(needle, min(GRAM, len(needle)))
                anchors.append(grams[np.argmin(rarity.value[grams % np.uint64(RARITY_SLOTS)])])
            yield batch.append_column("_gram", pa.array(np.array(anchors, np.uint64).view(np.int64)))

    filed = needles.mapInArrow(file, f"{term_col} string, _needle string, _gram bigint")
    sizes = [r[0] for r in needles.select(F.least(F.length("_needle"), F.lit(GRAM))).distinct().collect()]
    slot = F.pmod("_gram", F.lit(FILTER_BITS))
    words = filed.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_gram, {FILTER_BITS}) & 63 as int))")).alias("bits"))
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    for word, bits in words.collect():  # of fixed size, whatever the number of terms
        table[word] = bits
    known = spark.sparkContext.broadcast(table.view(np.uint64))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                grams = np.unique(np.concatenate([_grams(text, n) for n in sizes]))
                at = grams & np.uint64(FILTER_BITS - 1)
                grams = grams[(known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                row.append(np.full(len(grams), i))
                found.append(grams)
            if row:
                index = pa.array(np.concatenate(row), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k1").take(index), batch.column("_k2").take(index), pa.array(np.concatenate(found).view(np.int64))], ["_k1", "_k2", "_gram"])

    grams = keyed.select("_k1", "_k2", "_text").mapInArrow(look, "_k1 bigint, _k2 bigint, _gram bigint")
    candidates = grams.join(filed, "_gram").select("_k1", "_k2", term_col, "_needle").distinct()
    pairs = keyed.join(candidates, ["_k1", "_k2"]).where(F.contains("_text", "_needle"))
    return pairs.select(*every, term_col)


def _rarest(listed: DataFrame, name: str, part: str) -> DataFrame:
    """For every name the one of its parts that fewest names share."""
    uses = listed.groupBy(part).agg(F.count(F.lit(1)).alias("_uses"))
    order = Window.partitionBy(name).orderBy("_uses", F.length(part).desc(), part)
    ranked = listed.join(uses, part).withColumn("_r", F.row_number().over(order))
    return ranked.where("_r = 1").drop("_r", "_uses")


def tokens(text: Column) -> Column:
    """Lower-case word tokens (letters, digits, underscore; every script)."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda t: t != "")


def _may_be(anchors: DataFrame, token: str) -> Column:
    """A table of TOKEN_WORDS words of 64 bits, as one value: a bit is set for each anchor's hash."""
    slot = F.pmod(F.xxhash64(token), F.lit(TOKEN_WORDS * 64))
    bits = anchors.select(F.shiftright(slot, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({token}), {TOKEN_WORDS * 64}) & 63 as int))").alias("_bit"))
    words = bits.union(anchors.sparkSession.range(TOKEN_WORDS).select("id", F.lit(0).cast("long"))).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"]).alias("table")).scalar()


def match_names(df: DataFrame, text: str, names: DataFrame, name_col: str, key: str) -> DataFrame:
    """(row, name) pairs where the name stands in the text as a whole word, ignoring case.

    Each name is filed under the token fewest names share. Of a text's distinct tokens only those that may be such anchors
    leave the scan (a filter of fixed size tells); the equi-join's candidates are checked with the word-boundary pattern.
    """
    listed = names.dropDuplicates([name_col]).withColumn("_token", F.explode(F.array_distinct(tokens(F.col(name_col)))))
    anchors = _rarest(listed, name_col, "_token")
    quoted = F.regexp_replace(F.col(name_col), r"([^\p{L}\p{N}_\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b"))
    own = df.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_own"), _may_be(anchors, "_token").alias("_table"))
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(TOKEN_WORDS * 64))
    possible = F.filter("_own", lambda t: F.getbit(F.element_at("_table", (F.shiftright(slot(t), 6) + 1).cast("int")), (slot(t) % 64).cast("int")) == 1)
    filed = own.select("_key", F.explode(F.array_distinct(possible)).alias("_token"))
    candidates = filed.join(anchors, "_token").drop("_token")
    joined = df.join(candidates, df[key] == candidates["_key"]).drop("_key")
    return joined.where(F.regexp_like(F.col(text), pattern))
