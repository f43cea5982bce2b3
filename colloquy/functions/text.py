"""Text, time and scoring expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace, derived from the Unicode tables rather than typed in.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Markers of program code inside a message.
CODE_MARKERS = ["```", "def ", "function ", "class ", "import ", "const ", "let ", "var "]

# Path parts that carry no project meaning.
PATH_PARTS = ["Users", "Library", "Mobile", "Documents", "com", "apple", "CloudDocs"]

# Role synonyms of the chat formats.
ROLE_SYNONYMS = {
    "user": ["user", "human"],
    "assistant": ["assistant", "ai", "bot", "model", "gemini"],
}

# Conversation-id prefixes and the source each one names.
SOURCE_PREFIXES = [
    ("cc_", "claude-code"),
    ("chatgpt", "chatgpt"),
    ("cb_", "clawdbot"),
    ("clawdbot", "clawdbot"),
    ("cd_", "claude-desktop"),
]

# Phrases counted per command class.
COMMAND_PHRASES = {
    "depth": ["go deeper", "10x deeper", "20x deeper", "go further"],
    "redirect": ["no no no", "pivot", "wrong direction", "step back", "that's wrong"],
    "pace": ["slow down", "think first", "don't rush", "take your time"],
    "mode": ["think with me", "brainstorm", "sounding board", "rethink", "explore with me"],
    "identity": ["who am i", "essence of me", "understand me"],
}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("int")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def has_code(c: Column) -> Column:
    return flag(contains_any(c, CODE_MARKERS))


def has_url(c: Column) -> Column:
    return flag(c.contains("http://") | c.contains("https://"))


def preview(c: Column, n: int, suffix: str = "...") -> Column:
    """First n characters, marked when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def truncate_words(c: Column, n: int) -> Column:
    """Cut at n characters, then back to the last blank."""
    cut = F.regexp_replace(F.substring(c, 1, n), r" [^ ]*\z", "")
    return F.when(c.isNull(), F.lit("")).when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("...")))


def parse_ts(raw: Column, as_of: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e12), ISO or plain date text; as_of when nothing fits."""
    number = raw.try_cast("double")
    micros = F.when(number > 1e12, number * 1000.0).otherwise(number * 1e6)
    dated = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    return F.coalesce(F.timestamp_micros(F.round(micros).cast("long")), dated, as_of)


def normalize_role(raw: Column, default: str | None = None) -> Column:
    """Map synonyms to user or assistant; others become `default` (null drops them later)."""
    low = F.lower(raw)
    out = F.when(low.isin(ROLE_SYNONYMS["user"]), F.lit("user"))
    out = out.when(low.isin(ROLE_SYNONYMS["assistant"]), F.lit("assistant"))
    return out.otherwise(F.lit(default).cast("string"))


def project_name(directory: Column) -> Column:
    """Readable project name from an encoded directory name."""
    name = F.ltrim(directory, F.lit("-"))
    parts = F.filter(F.split(name, "-"), lambda p: ~p.isin(PATH_PARTS))
    tail = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    return F.when(F.size(parts) > 0, F.array_join(tail, "-")).otherwise(F.right(name, F.lit(50)))


def guess_source(conversation_id: Column) -> Column:
    low = F.lower(conversation_id)
    out = F.when(low.startswith(SOURCE_PREFIXES[0][0]), F.lit(SOURCE_PREFIXES[0][1]))
    for prefix, source in SOURCE_PREFIXES[1:]:
        out = out.when(low.startswith(prefix), F.lit(source))
    return out.otherwise(F.lit("unknown"))


def match_label(score: Column) -> Column:
    return (
        F.when(score > 0.9, "Best match")
        .when(score >= 0.7, "Good match")
        .when(score >= 0.5, "Related")
        .otherwise("Weak match")
    )


def match_class(score: Column) -> Column:
    return F.when(score > 0.9, "match-best").when(score >= 0.7, "match-good").otherwise("match-related")


def similarity_class(score: Column) -> Column:
    return F.when(score >= 0.8, "sim-high").when(score >= 0.6, "sim-med").otherwise("sim-low")


def similarity_dot(score: Column) -> Column:
    return F.when(score >= 0.8, "\U0001f7e2").when(score >= 0.6, "\U0001f7e1").otherwise("\U0001f534")


def cite(row_id: Column, ts: Column) -> Column:
    """Citation marker: short id and day, the id alone, or nothing."""
    short = F.left(row_id.cast("string"), F.lit(12))
    day = F.left(ts.cast("string"), F.lit(10))
    inner = F.concat_ws(" · ", short, day)
    return F.when(row_id.isNull() | (row_id.cast("string") == ""), F.lit("")).otherwise(
        F.concat(F.lit("["), inner, F.lit("]"))
    )


def normalize_domain(c: Column) -> Column:
    return F.coalesce(F.replace(F.lower(strip(c)), F.lit("_"), F.lit("-")), F.lit(""))


def phrase_counts(text: Column) -> dict[str, Column]:
    """Number of phrase hits of each command class in one text."""
    low = F.lower(text)
    return {
        name: F.regexp_count(low, F.lit("|".join(phrases))).cast("long")
        for name, phrases in COMMAND_PHRASES.items()
    }


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    share = F.when(whole > 0, part.cast("double") * 100.0 / whole.cast("double")).otherwise(F.lit(0.0))
    return F.round(share, digits)
