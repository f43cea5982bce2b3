"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import pick, release

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters hashed at once; longer texts are taken in parts that overlap by the longest n-gram.
CHARS = 500_000
#: Rows whose texts are held as strings at once.
ROWS = 500
ALPHA = 0.5
MOST_LANGUAGES = 1_000
UNKNOWN = "und"
#: Row of the counts that holds a language's number of documents.
N_DOCS = -1


def _fold() -> np.ndarray:
    """ASCII letters in lower case, all other ASCII as a blank."""
    table = np.full(128, 32, np.uint32)
    letters = np.arange(ord("a"), ord("z") + 1)
    table[letters] = table[letters - 32] = letters
    return table


def hashed_grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of all n-grams of all texts, in parts of bounded size; text numbers do not fall."""
    fold, reach = _fold(), max(orders) - 1
    parts = [(i, t[s:s + CHARS + reach], min(CHARS, len(t) - s)) for i, t in enumerate(texts) for s in range(0, len(t), CHARS)]
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][1]) <= CHARS):
            size += len(parts[end][1])
            end += 1
        some, at = parts[at:end], end
        points = np.frombuffer("".join(t for _, t, _ in some).encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(points < 128, fold[np.minimum(points, 127)], points).astype(np.uint64)
        lengths = np.array([len(t) for _, t, _ in some])
        stops = np.cumsum(lengths)
        left = np.repeat(stops, lengths) - np.arange(len(points))  # characters of the part from here on
        own = np.arange(len(points)) - np.repeat(stops - lengths, lengths) < np.repeat([n for _, _, n in some], lengths)
        number = np.repeat([i for i, _, _ in some], lengths)
        for n in orders:
            hashed = np.full(len(points) - n + 1 if len(points) >= n else 0, n, np.uint64)
            for k in range(n):
                hashed = (hashed ^ points[k:k + len(hashed)]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            good = (left[:len(hashed)] >= n) & own[:len(hashed)]
            yield number[:len(hashed)][good], (hashed[good] * np.uint64(0xD1B54A32D192ED03) >> np.uint64(40)).astype(np.int64) % buckets


def train(
    labelled: DataFrame, lang: str = "lang", text: str = "text", orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS,
    alpha: float = ALPHA,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the log-probability matrix (buckets x languages), from all rows with text and lang.

    Each task counts into arrays and passes on its non-zero counts; at most languages x buckets sums reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for name in set(langs):
                own = [t for x, t in zip(langs, texts) if x == name]
                table = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                table[-1] += len(own)
                for _, grams in hashed_grams(own, orders, buckets):
                    table[:-1] += np.bincount(grams, minlength=buckets)
        for name, table in sums.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(some)), "bucket": pa.array(np.where(some == buckets, N_DOCS, some).astype(np.int32)),
                "n": pa.array(table[some])})
        release()

    rows = pick(labelled, lang=lang, text=text).where("lang is not null and text is not null")
    rows = rows.select("lang", F.lower("text").alias("text"))
    if (n := rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages ({n})")
    sums = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_numpy()
    langs = sorted(set(names))
    column, bucket, n = np.searchsorted(langs, names), sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    docs, grams = np.zeros(len(langs)), np.full((buckets, len(langs)), alpha)
    docs[column[bucket == N_DOCS]] = n[bucket == N_DOCS]
    grams[bucket[bucket >= 0], column[bucket >= 0]] += n[bucket >= 0]
    return langs, np.log(docs / docs.sum()) if langs else docs, np.log(grams / grams.sum(axis=0))


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", orders: tuple[int, ...] = ORDERS, excess: bool = False,
) -> DataFrame:
    """`docs` with lang_pred and score: the likeliest language and its posterior probability over the whole text.

    With `excess` also how much less likely, in nats for an n-gram, the text is than that language's own texts are on the
    average (`excess`; null for `und`) and the number of its n-grams (`n_grams`): the posterior only compares languages.

    The matrix is broadcast; its size is languages x buckets. Texts that are null or without a letter, and all texts when
    nothing was learned, get `und` and 0. Equal scores go to the first language in order. Columns named like the new ones are replaced.
    """
    langs, prior, table = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(table.T)))
    buckets = len(table)
    usual = -(np.exp(table) * table).sum(axis=0)  # a language's entropy: what its own n-grams cost on the average

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, by_lang = sent.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [t if ok else "" for t, ok in zip(batch.column("__low").to_pylist(), batch.column("__ok").to_pylist())]
            sums, sizes = np.zeros((len(texts), max(1, len(langs)))), np.zeros(len(texts), np.int64)
            for number, grams in hashed_grams(texts, orders, buckets) if langs else ():
                if len(number):
                    if excess:
                        sizes += np.bincount(number, minlength=len(texts))
                    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                    for j in range(len(langs)):
                        sums[number[starts], j] += np.add.reduceat(by_lang[j][grams], starts)
            good = np.array([bool(t) and bool(langs) for t in texts], bool)
            plain = sums
            sums = sums + prior if langs else sums
            best = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1) if len(texts) else np.zeros(0)
            names = [langs[b] if g else UNKNOWN for b, g in zip(best, good)]
            columns = [pa.array(names, pa.string()), pa.array(np.where(good, share, 0.0))]
            if excess:
                cost = -plain[np.arange(len(texts)), best] / np.maximum(sizes, 1) - (usual[best] if langs else 0)
                columns += [pa.array(cost, mask=~good), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{i}") for i in range(width)), *columns], [*(f"c{i}" for i in range(width)), *new])
        release()

    new = ["lang_pred", "score", *(["excess", "n_grams"] if excess else [])]
    keep = [c for c in docs.columns if c not in new]
    width, plain = len(keep), docs.select(*[c for c in keep]).toDF(*[f"c{i}" for i in range(len(keep))])
    content = F.col(f"c{keep.index(text)}")
    ready = plain.withColumns({"__ok": F.coalesce(content.rlike(r"\p{L}"), F.lit(False)), "__low": F.lower(content)})
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(plain.dtypes)) + ", lang_pred string, score double"
    return ready.mapInArrow(score, schema + (", excess double, n_grams bigint" if excess else "")).toDF(*keep, *new)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """True for the fold kept from learning; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows of `docs` that are not held out and have a lang.

    Trains at once (one job). Repeated rows each give one row; an empty table gives none; only doc_id and text go on.
    """
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang).withColumn("held_out", held_out())
    model = train(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
