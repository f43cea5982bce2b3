"""Usage telemetry: tool popularity, funnel, errors, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ranking import exact_percentile


# The events of the setup funnel.
FUNNEL = ["setup_started", "setup_completed", "setup_failed", "first_query"]


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def tool_calls(events: DataFrame) -> DataFrame:
    return (
        events.where("event = 'tool_called'")
        .select("machine_id", "ts", F.from_json("props", "tool string, latency_ms double").alias("p"))
        .select("machine_id", "ts", "p.tool", "p.latency_ms")
        .where("tool IS NOT NULL")
    )


def tool_popularity(events: DataFrame) -> DataFrame:
    """Calls, users, mean and exact 95th percentile latency of each tool."""
    calls = tool_calls(events)
    totals = calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.countDistinct("machine_id").alias("users"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    )
    tail = exact_percentile(calls, ["tool"], "latency_ms", 0.95, "p95_latency_ms")
    return totals.join(tail, "tool", "left").withColumn("p95_latency_ms", F.round("p95_latency_ms", 6))


def funnel(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(FUNNEL)).groupBy("event").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("machine_id").alias("unique_machines")
    )


def error_rates(events: DataFrame) -> DataFrame:
    return events.where("event = 'error'").groupBy(
        prop("tool").alias("tool"), prop("error_type").alias("error_type")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def weekly_growth(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        F.countDistinct("machine_id").alias("active_machines"),
        F.countDistinct(F.when(F.col("event") == "setup_completed", F.col("machine_id"))).alias("new_installs"),
        F.count_if(F.col("event") == "tool_called").alias("total_tool_calls"),
    )
