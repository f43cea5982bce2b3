"""From documents to packed sequences: STAGES in order, each on what the one before it kept.

Each stage but the last returns rows with the columns of documents. Rows are told apart by doc_id and content, so repeated
ids, null ids and further columns do no harm; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup, language, mixing, near_dedup, packing
from colloquy.llm.common import documents, prepare, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document is rejected when no language has at least this probability among those learned, or when its n-grams are less
#: likely than that language's usual ones by more than so many nats, with room for short texts (a part by the root of their number).
LEAST_SCORE = 0.5
MOST_EXCESS, SHORT_ROOM = 2.5, 8.0


def _mark(doc_id: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), digest), 256)


def _kept(docs: DataFrame, marks: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """One row of `docs` for each of `marks` (doc_id, digest). Id and digest make one key, so no copy's group gathers anywhere."""
    names = docs.columns
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("mark", _mark(doc_id, digest(text)))
    stay = rows.join(marks.select(_mark(F.col("doc_id"), F.col("digest")).alias("mark")), "mark", "left_semi")
    first = F.row_number().over(Window.partitionBy("mark").orderBy(F.lit(0)))
    return stay.withColumn("nth", first).where("nth = 1").drop("mark", "nth").toDF(*names)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter, or unlike all languages learned, go.

    Where no document has both a text and a language, nothing can be learned, and only documents without a letter go.
    """
    prepare(spark)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text, lang = (f"c{names.index(n)}" for n in ("doc_id", "text", "lang"))
    model = language.train(rows.where(~language.held_out(doc_id)), lang, text)
    if not model[0]:
        return rows.where(F.col(text).rlike(r"\p{L}")).toDF(*names)
    found = language.predict(rows, model, text, excess=True)
    known = F.col("excess") <= MOST_EXCESS + SHORT_ROOM / F.sqrt("n_grams")
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & known)
    return kept.drop("lang_pred", "score", "excess", "n_grams").toDF(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    prepare(spark)
    kept = exact_dedup.dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return _kept(docs, kept, lambda text: F.sha2(exact_dedup.normalised(text), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id", F.hex("key").alias("digest"))
    return _kept(docs, kept, lambda text: F.upper(F.md5(F.coalesce(text, F.lit("")))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each copy."""
    prepare(spark)
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: where each piece of each document goes."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language identification", identify),
    ("exact deduplication", drop_copies),
    ("near deduplication", drop_near_copies),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: Languages are learned and tokens are looked up, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
