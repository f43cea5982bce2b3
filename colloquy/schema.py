"""Table schemas: messages, turns, summaries, vectors, telemetry and the citation layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in spec.items()])


STR, INT, LONG, TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

# Column order of the canonical message table.
MESSAGES = _struct(
    {
        "source": STR, "model": STR, "project": STR,
        "conversation_id": STR, "conversation_title": STR,
        "created": TS, "updated": TS,
        "year": INT, "month": INT, "day_of_week": STR, "hour": INT,
        "message_id": STR, "parent_id": STR, "msg_index": INT,
        "msg_timestamp": TS, "timestamp_is_fallback": INT,
        "role": STR, "content_type": STR,
        "is_first": INT, "is_last": INT,
        "word_count": INT, "char_count": INT, "conversation_msg_count": INT,
        "has_code": INT, "has_url": INT, "has_question": INT,
        "has_attachment": INT, "has_citation": INT,
        "content": STR, "temporal_precision": STR,
    }
)

SUMMARIES = _struct(
    {
        "conversation_id": STR, "source": STR, "title": STR, "msg_count": LONG,
        "summary": STR, "concepts": T.ArrayType(STR), "decisions": T.ArrayType(STR),
        "open_questions": T.ArrayType(STR), "quotable": T.ArrayType(STR),
        "key_insights": T.ArrayType(STR), "connections_to": T.ArrayType(STR),
        "importance": STR, "domain_primary": STR, "domain_secondary": STR,
        "thinking_stage": STR, "emotional_tone": STR, "cognitive_pattern": STR,
        "problem_solving_approach": STR, "content_category": STR,
        "resurface_when": STR, "command_language": STR, "edges_json": STR, "corrections_json": STR,
        "temporal_facts_json": STR, "assets_json": STR, "embedding_text": STR,
        "summarized_at": TS, "summary_hash": STR,
    }
)

MESSAGE_VECTORS = _struct(
    {
        "message_id": STR, "conversation_id": STR, "conversation_title": STR,
        "content": STR, "role": STR, "year": INT, "month": INT,
        "embedding": T.ArrayType(T.FloatType()), "created_at": TS,
    }
)

TELEMETRY = _struct(
    {
        "id": LONG, "ts": TS, "machine_id": STR, "event": STR, "props": STR,
        "version": STR, "os": STR, "python": STR,
    }
)

# The permitted terms of the enumerated columns.
ROLES = ["user", "assistant", "system", "tool"]
PRECISIONS = ["exact", "day", "approximate"]
VISIBILITIES = ["private", "tenant", "public"]
STAGES = ["exploring", "crystallizing", "refining", "executing"]
IMPORTANCE = ["breakthrough", "significant", "routine"]
EXTRACTION_TYPES = ["embedding", "keyword-index", "entity", "noise-filter"]
SYNTHESIS_TYPES = [
    "enhanced-extraction-v5", "tunnel-state-cache", "context-recovery-cache",
    "thinking-trajectory-cache", "what-do-i-think-cache",
]
FUSION_TYPES = ["dormant-contexts", "open-threads", "switching-cost", "alignment-check", "tunnel-history"]
RELATIONS = [
    "influences", "implements", "depends-on", "extends", "part-of",
    "gave-birth-to", "evolved-from", "contradicts", "replaced-by",
]
ASSET_KINDS = [
    "quote", "framework-articulation", "business-idea",
    "architectural-insight", "thesis-statement", "graveyard-item",
]
CORRECTION_TYPES = ["factual", "timeline", "relationship", "importance", "attribution", "definition", "domain"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, adding typed nulls for the absent ones."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def turns(messages: DataFrame) -> DataFrame:
    """The narrow turn view of the message table."""
    return messages.select(
        F.col("msg_timestamp").alias("ts"),
        F.col("source").alias("src"),
        F.col("conversation_id").alias("conv_id"),
        "role",
        F.col("content").alias("text"),
        "message_id",
    )
