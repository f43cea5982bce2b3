"""Awkward documents for all operators: nulls, empty and long texts, copies, repeated rows, columns with clashing names."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "`TEXT` string, hash string, bucket int, shard int, row string, mark int, lang_pred string, n_tokens int, node int"
)
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
CLASH = ("other", "h", 1, 2, "r", 3, "xx", 4, 5)


def near(n: int, changed: int = -1) -> str:
    return " ".join(f"w{n}x{i}" if i != changed else "changed" for i in range(60))


TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
    (2, None, "en", "a"), (3, "", "en", "b"), (4, "", None, None), (5, " \t\n ", "de", "b"), (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "a"), (7, LONG, "en", "c"), (8, "le chat est sur la table et le chien dort", "fr", "a"),
    (9, "der hund und die katze sind nicht hier", "de", None), (10, "the cat and the dog are not here", "en", "b"),
    (11, "the  cat and\nthe dog are not here", "en", "b"), (12, "12345 67890 !!!", "en", "a"), (None, "no id at all here", "en", "a"),
    (None, None, None, None), (None, "no id at all here", "en", "a"), (13, "été 日本 \U0001f600<|endoftext|> x y", "fr", "c"),
    (13, "same id, other text", "en", "c"), (20, near(1), "en", "a"), (21, near(1, 59), "en", "b"), (22, near(1, 0), "en", "b"),
    (23, near(1, 30), "en", "b"), (30, "one two", "en", "a"), (31, "ONE TWO", "en", "a"), (32, near(2), "en", "a"),
]


def rows():
    return [(i, t, lang, source, len(t or ""), *CLASH) for i, t, lang, source in TEXTS]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
