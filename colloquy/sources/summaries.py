"""Summary records (JSON lines) to the summary table, and their decoded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions import text as tx
from colloquy.functions.jsonlist import item_names, json_list


_DATA = ["summary", "concepts", "decisions", "open_questions", "quotable", "importance", "domain_primary", "domain_secondary",
         "thinking_stage", "emotional_tone", "cognitive_pattern", "command_language", "edges", "corrections", "temporal_facts", "assets"]
_SUMMARY = ["text", "quotable", "importance", "domain_primary", "domain_secondary", "thinking_stage", "emotional_tone",
            "cognitive_pattern", "resurface_when"]


def _strings(names: list[str]) -> str:
    return ", ".join(f"{n} string" for n in names)


def summaries_from_records(lines: DataFrame, summarized_at=None) -> DataFrame:
    """Summary table of record lines in the current shape (summary is an object) and the older one (text).

    A line is parsed once, its summary object once more; nested values stay JSON text until decoded.
    """
    outer = f"conversation_id string, source string, title string, msg_count bigint, data struct<{_strings(_DATA).replace(' string', ':string')}>"
    rows = (
        lines.withColumn("r", F.from_json("value", outer))
        .where("r.conversation_id IS NOT NULL OR r.data IS NOT NULL")
        .select("r.*")
        .withColumn("_current", F.coalesce(F.ltrim("data.summary").startswith("{"), F.lit(False)))
        .withColumn("s", F.when(F.col("_current"), F.from_json("data.summary", _strings(_SUMMARY))))
    )

    def field(name: str, default: str = "") -> Column:
        return F.coalesce(F.when(F.col("_current"), F.col(f"s.{name}")).otherwise(F.col(f"data.{name}")), F.lit(default))

    summary = F.coalesce(F.when(F.col("_current"), F.col("s.text")).otherwise(F.col("data.summary")), F.lit(""))
    quote = F.when(F.col("_current"), F.col("s.quotable")).otherwise(F.col("data.quotable"))
    # Decoded in a step of their own, so that the columns and the embedding text share the result.
    rows = rows.withColumns({
        "concepts": item_names(json_list(F.col("data.concepts")), "name"),
        "decisions": item_names(json_list(F.col("data.decisions")), "text"),
        "open_questions": item_names(json_list(F.col("data.open_questions")), "text"),
    })
    resurface = F.coalesce("s.resurface_when", F.lit(""))

    def labelled(label: str, body: Column) -> Column:
        return F.when(body != "", F.concat(F.lit(label), body))

    when = F.current_timestamp() if summarized_at is None else F.lit(summarized_at).cast("timestamp")
    out = rows.select(
        F.coalesce("conversation_id", F.lit("")).alias("conversation_id"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("msg_count", F.lit(0)).alias("msg_count"), summary.alias("summary"), "concepts", "decisions", "open_questions", json_list(quote).alias("quotable"),
        field("importance", "routine").alias("importance"),
        tx.normalize_domain(field("domain_primary")).alias("domain_primary"),
        tx.normalize_domain(field("domain_secondary")).alias("domain_secondary"),
        field("thinking_stage").alias("thinking_stage"), field("emotional_tone").alias("emotional_tone"),
        field("cognitive_pattern").alias("cognitive_pattern"), resurface.alias("resurface_when"),
        F.concat_ws(
            ". ", summary, labelled("Concepts: ", F.array_join("concepts", ", ")),
            labelled("Decisions: ", F.array_join("decisions", "; ")),
            labelled("Open questions: ", F.array_join("open_questions", "; ")), labelled("Resurface: ", resurface),
        ).alias("embedding_text"),
        F.coalesce("data.command_language", F.lit("{}")).alias("command_language"),
        *[F.coalesce(f"data.{name}", F.lit("[]")).alias(f"{name}_json") for name in ("edges", "corrections", "temporal_facts", "assets")],
        when.alias("summarized_at"), F.left(F.md5(summary), F.lit(16)).alias("summary_hash"),
    )
    return schema.conform(out, schema.SUMMARIES)


def decode_records(lines: DataFrame) -> DataFrame:
    """Typed lists of record lines: concepts, edges, corrections, temporal facts, assets, command counts."""
    fields = (
        "conversation_id string, data struct<"
        "concepts:array<string>,"
        "edges:array<struct<`from`:string,`to`:string,relation:string,confidence:double,evidence:string>>,"
        "corrections:array<struct<subject:string,wrong_claim:string,correct_claim:string,correction_type:string,source:string>>,"
        "temporal_facts:array<struct<subject:string,key:string,value:string,value_type:string,context:string>>,"
        "assets:array<struct<kind:string,title:string,content:string,domain:string,tags:array<string>>>,"
        "command_language:struct<depth:int,redirect:int,pace:int,mode:int,identity:int>>"
    )
    return lines.select(F.from_json("value", fields).alias("r")).where("r.conversation_id IS NOT NULL").select(
        "r.conversation_id", "r.data.*"
    )


def append_records(records: DataFrame, path: str, full: bool = False) -> None:
    """Write record lines: append to the store, or replace it."""
    records.write.mode("overwrite" if full else "append").text(path)


def summarize(transcripts: DataFrame, summarizer, batch: int = 10) -> DataFrame:
    """Record lines made by the caller's summarizer, called inside the tasks on lists of transcript texts.

    `summarizer` takes a list of texts and returns JSON texts (None skips the conversation).
    """
    import json

    def run(frames):
        import pandas as pd

        for frame in frames:
            made = []
            rows = frame.to_dict("records")
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                for row, answer in zip(part, summarizer([r["text"] for r in part])):
                    if answer is None:
                        continue
                    keep = {k: row[k] for k in ("conversation_id", "source", "title")}
                    made.append(json.dumps({**keep, "msg_count": int(row["msg_count"]), "data": json.loads(answer)}))
            yield pd.DataFrame({"value": made})

    return transcripts.mapInPandas(run, "value string")
