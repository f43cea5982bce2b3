"""Secret scans on DataFrame functions: base patterns, and sliding-window entropy over long strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import pick

#: The base patterns by kind, in their order. For hex and access the least length is in the pattern, which
#: finds the same spans as filtering afterwards: a shorter run holds no longer one.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}"))
LEAST_ASSIGNED = 6
#: Classes of characters: name, alphabet, window, least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", "0123456789ABCDEFabcdef", 20, 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidate strings that are never secrets: words, numbers, UUIDs, one character or pair repeated.
ALLOWED = (r"^[A-Za-z/_=-]+$", r"^[0-9/_=-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^(.{1,2})\1+.?$")
#: Placeholders clear the letters and digits they stand among, so many on either side, and not what is beyond.
PLACEHOLDER, REACH = r"(?i)example|sample|placeholder|dummy|xxxxxx|1234567890|abcdefghij", 40
#: Windows of a long string that are looked at together.
SLICE = 256
RUNS = "array<struct<start: int, stop: int>>"
SPAN = "array<struct<start: bigint, stop: bigint, kind: string, order: int>>"
MATCH = "array<struct<start: bigint, stop: bigint, match: string>>"


def _found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: (between: string before the match, match: string)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("between"), matches.alias("match"))


def _placed(found: Column) -> Column:
    """Matches with their place in code points: (start, stop, match)."""

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["between"])
        stop = start + F.length(x["match"])
        spans = F.concat(done["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match"))))
        return F.struct(stop.alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(MATCH).alias("spans"))
    return F.aggregate(found, empty, step, lambda done: done["spans"])


def _bits(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def _runs(string: Column, alphabet: str, window: int, least: float) -> Column:
    """Runs of the windows of class characters whose entropy is at least `least`: (start, stop) in the string, in order.

    Windows that overlap or touch are one run. The string is looked at in slices of SLICE windows, so the work grows with
    its length only; runs that meet at a border become one.
    """
    slices = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(string) - window, F.lit(0)) / SLICE).cast("int")), lambda k: F.struct(
        (k * SLICE).alias("at"), F.substring(string, k * SLICE + 1, F.lit(SLICE + window - 1)).alias("part")))
    runs = F.flatten(F.transform(slices, lambda s: F.transform(_slice_runs(s["part"], alphabet, window, least), lambda run: F.struct(
        (s["at"] + run["start"]).alias("start"), (s["at"] + run["stop"]).alias("stop")))))

    def closed(state: Column) -> Column:
        return F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["stop"].alias("stop"))))

    def step(state: Column, run: Column) -> Column:
        apart = F.coalesce(state["stop"] < run["start"], F.lit(False))
        return F.struct(
            F.when(apart, closed(state)).otherwise(state["done"]).alias("done"),
            F.when(apart | state["start"].isNull(), run["start"]).otherwise(state["start"]).alias("start"), run["stop"].alias("stop"))

    fresh = F.struct(F.array().cast(RUNS).alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))
    return F.aggregate(runs, fresh, step, lambda s: F.when(s["stop"].isNotNull(), closed(s)).otherwise(s["done"]))


def _slice_runs(string: Column, alphabet: str, window: int, least: float) -> Column:
    """The runs of a short string. One pass: the counts of the window's characters and the sum of n log2 n change by the
    character that enters and the one that leaves. A character outside the class empties the window.
    """
    letters = F.lit(alphabet)

    def closed(state: Column) -> Column:
        return F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["stop"].alias("stop"))))

    def step(state: Column, x: Column) -> Column:
        i, entering = x["i"], x["enters"]
        leaving = F.when(state["run"] >= window, x["leaves"]).otherwise(F.lit(0))
        grown = F.element_at(state["counts"], F.greatest(entering, F.lit(1)))
        shrunk = F.element_at(state["counts"], F.greatest(leaving, F.lit(1)))
        change = F.when(entering == leaving, F.lit(0.0)).otherwise(
            _bits(grown + 1) - _bits(grown) + F.when(leaving > 0, _bits(shrunk - 1) - _bits(shrunk)).otherwise(F.lit(0.0)))
        counts = F.transform(
            state["counts"], lambda n, j: n + F.when(j + 1 == entering, 1).otherwise(0) - F.when(j + 1 == leaving, 1).otherwise(0))
        total, run = state["sum"] + change, state["run"] + 1
        hit = (run >= window) & (F.lit(math.log2(window)) - total / window >= least)
        apart = F.coalesce(state["stop"] < i - window, F.lit(False))
        return F.when(entering == 0, F.struct(
            F.transform(state["counts"], lambda n: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("run"),
            state["done"].alias("done"), state["start"].alias("start"), state["stop"].alias("stop"),
        )).otherwise(F.struct(
            counts.alias("counts"), total.alias("sum"), run.alias("run"),
            F.when(apart & hit, closed(state)).otherwise(state["done"]).alias("done"),
            F.when((apart | state["start"].isNull()) & hit, i - window).otherwise(state["start"]).alias("start"),
            F.when(hit, i).otherwise(state["stop"]).alias("stop"),
        ))

    fresh = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("run"),
        F.array().cast(RUNS).alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"),
    )
    places = F.sequence(F.lit(1), F.length(string))
    numbers = F.transform(places, lambda i: F.instr(letters, F.substring(string, i, F.lit(1))))
    steps = F.arrays_zip(places.alias("i"), numbers.alias("enters"), F.slice(F.concat(F.array_repeat(F.lit(0), window), numbers), F.lit(1), F.length(string)).alias("leaves"))
    return F.aggregate(steps, fresh, step, lambda s: F.when(s["stop"].isNotNull(), closed(s)).otherwise(s["done"]))


def _dense(string: Column, alphabet: str, window: int, least: float) -> Column:
    """Hull of the runs: (start, stop) in the string, or nulls."""
    runs = _runs(string, alphabet, window, least)
    return F.struct(F.array_min(runs)["start"].alias("start"), F.array_max(runs)["stop"].alias("stop"))


def _without(strings: Column, spans: Column) -> Column:
    """What is left of placed strings outside of `spans` (in order of their starts), as placed strings."""
    def left(x: Column) -> Column:
        def part(at: Column, stop: Column) -> Column:
            string = F.substring(x["match"], (at - x["start"] + 1).cast("int"), (stop - at).cast("int"))
            return F.array(F.struct(at.alias("start"), stop.alias("stop"), string.alias("match")))

        def step(done: Column, s: Column) -> Column:
            parts = F.when(s["start"] > done["at"], F.concat(done["parts"], part(done["at"], s["start"]))).otherwise(done["parts"])
            return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), parts.alias("parts"))

        cut = F.filter(spans, lambda s: (s["start"] < x["stop"]) & (x["start"] < s["stop"]))
        none = F.struct(x["start"].alias("at"), F.array().cast(MATCH).alias("parts"))
        rest = F.aggregate(cut, none, step, lambda done: F.when(
            done["at"] < x["stop"], F.concat(done["parts"], part(done["at"], x["stop"]))).otherwise(done["parts"]))
        return F.when(F.size(cut) == 0, F.array(x)).otherwise(rest)

    return F.flatten(F.transform(strings, left))


def _placeholders(strings: Column) -> Column:
    """Spans (start, stop) that the placeholders in placed strings clear."""
    def spread(x: Column) -> Column:
        def around(word: Column) -> Column:
            low = F.greatest(word["start"] - REACH, F.lit(0))
            before = F.substring(x["match"], (low + 1).cast("int"), (word["start"] - low).cast("int"))
            after = F.substring(x["match"], (word["stop"] + 1).cast("int"), F.lit(REACH))
            return F.struct(
                (x["start"] + word["start"] - F.length(F.regexp_extract(before, "[A-Za-z0-9+]*$", 0))).alias("start"),
                (x["start"] + word["stop"] + F.length(F.regexp_extract(after, "^[A-Za-z0-9+]*", 0))).alias("stop"))

        return F.transform(_placed(_found(x["match"], PLACEHOLDER)), around)

    return F.flatten(F.transform(F.filter(strings, lambda x: x["match"].rlike(PLACEHOLDER)), spread))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, secrets (the spans as structs) for every row.

    Base spans are whole matches of the three patterns. Strings of 20 and more characters are further candidates, unless an
    allow-list pattern holds for them. Base spans, and letters and digits around a placeholder, are taken out of a candidate; what
    is left are candidates of their own. Each run of their windows of high entropy is added, for each class; those of the first
    class are taken out before the second. Null texts count as empty: no spans, the digest of an empty list. Repeated
    rows each give one row; an empty table gives none; other columns are ignored.
    """
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = [*BASE, ("candidate", CANDIDATE)]
    found = rows.select("doc_id", *[_found(F.col("text"), pattern).alias(kind) for kind, pattern in kinds])
    placed = found.select("doc_id", *[_placed(F.col(kind)).alias(kind) for kind, _ in kinds])
    good = F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= LEAST_ASSIGNED)
    placed = placed.withColumn("assign", good)

    def spans(kind: str, order: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lit(order).alias("order")))

    def by_place(array: Column) -> Column:
        ordered = F.array_sort(F.transform(array, lambda s: F.struct(s["start"], s["order"], s["stop"], s["kind"])))
        return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["order"].alias("order")))

    def suspect(string: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | string.rlike(pattern)
        return ~allowed

    def cut(spans: Column) -> Column:
        """The candidates' parts outside of `spans`; a new part is looked at without the joints it was cut at."""
        return F.filter(_without(F.col("candidate"), spans), lambda x: (F.length(x["match"]) >= CLASSES[0][2]) & (
            F.exists("candidate", lambda c: (c["start"] == x["start"]) & (c["stop"] == x["stop"]))
            | suspect(F.regexp_replace(x["match"], "^[/_=+-]+|[/_=+-]+$", ""))))

    base = placed.withColumns({
        **{f"n_{kind}": F.size(kind).cast("long") for kind, _ in BASE},
        "base": by_place(F.concat(*[spans(kind, i) for i, (kind, _) in enumerate(BASE)])),
        "candidate": F.filter("candidate", lambda x: suspect(x["match"])),
    }).withColumn("candidate", cut(_placeholders(F.col("candidate")))).withColumn("candidate", cut(F.col("base"))).withColumn("spans", F.col("base").cast(SPAN))
    for i, (kind, alphabet, window, least) in enumerate(CLASSES):
        if i:
            base = base.withColumn("candidate", cut(F.col("found")))
        found = F.flatten(F.transform("candidate", lambda x: F.transform(_runs(x["match"], alphabet, window, least), lambda run: F.struct(
            (x["start"] + run["start"]).alias("start"), (x["start"] + run["stop"]).alias("stop"), F.lit(kind).alias("kind"), F.lit(len(BASE) + i).alias("order")))))
        base = base.withColumn("found", found.cast(SPAN)).withColumn("spans", by_place(F.concat("spans", "found")))
    return base.select(
        "doc_id", *[f"n_{kind}" for kind, _ in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), F.col("spans").alias("secrets"),
    )
