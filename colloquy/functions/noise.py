"""Classification of messages that carry no meaning of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import strip

# Openings and whole texts of messages written by tools, not people.
TOOL_TEXTS = ["[tool result]", "warmup"]
TOOL_OPENINGS = ["[request interrupted", "[image: user uploaded", "<local-command"]

# Whole-message confirmations.
CONFIRMATIONS = [
    "cont", "continue", "yes", "y", "yeah", "yep", "yea", "no", "n", "nope", "nah",
    "ok", "okay", "sure", "right", "exactly", "correct", "perfect", "great", "good",
    "nice", "cool", "done",
]

# Whole-message commands too general to search for.
COMMANDS = [
    "more", "next", "go", "go for it", "do it", "run it", "please run it", "try again",
    "impl", "shorter", "all", "help", "hi", "hello", "thanks", "thank you", "full code",
    "do better", "now", "now?", "dont", "stop",
]

# Single letters, numbers and process kills.
TOKEN_PATTERN = r"(?i)^([a-z]|[0-9]+x?|kill [0-9]+)$"

# No listed text or opening is longer, so longer messages need not be put in lower case.
LONGEST = 64


def drop_reason(content: Column) -> Column:
    """Reason a message counts as noise, null when it does not."""
    text = strip(content)
    head = F.lower(F.left(text, F.lit(LONGEST)))
    short = F.length(text) <= LONGEST
    opening = F.lit(False)
    for start in TOOL_OPENINGS:
        opening = opening | head.startswith(start)
    return (
        F.when((short & head.isin(TOOL_TEXTS)) | opening, "tool-output")
        .when(short & head.isin(CONFIRMATIONS), "confirmation")
        .when(short & head.isin(COMMANDS), "generic-command")
        .when(text.rlike(TOKEN_PATTERN), "single-token")
    )


def is_noise(content: Column) -> Column:
    return drop_reason(content).isNotNull()
