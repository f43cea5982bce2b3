"""Rule checks, coverage and overview figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions.jsonlist import NONE_TEXT
from colloquy.functions.text import percent
from colloquy.operators.links import citation_ids



def _broken(df: DataFrame, layer: str, rules: dict[str, Column]) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules.items()]))
    return df.select(F.lit(layer).alias("layer"), F.col("id").alias("row_id"), F.explode(named).alias("rule"))


def _repeated(df: DataFrame, layer: str, keys: list[str]) -> DataFrame:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return (
        df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("row_id")).where("_n > 1")
        .select(F.lit(layer).alias("layer"), "row_id", F.lit("unique " + ",".join(keys)).alias("rule"))
    )


def _not_in(column: str, allowed: list[str]) -> Column:
    return ~F.col(column).isin(allowed)


def layer_violations(l0: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """Rows that break a rule of the layered model; repeated keys are reported once, by their lowest id."""
    cited = {k: F.size(citation_ids(F.col("citations"), k)) for k in ("l0_ids", "l1_ids", "l2_ids")}
    parts = [
        _broken(l0, "L0", {
            "role": _not_in("role", schema.ROLES),
            "temporal_precision": _not_in("temporal_precision", schema.PRECISIONS),
            "visibility": _not_in("visibility", schema.VISIBILITIES),
        }),
        _repeated(l0, "L0", ["tenant_id", "source", "message_id"]),
        _broken(l1, "L1", {
            "extraction_type": _not_in("extraction_type", schema.EXTRACTION_TYPES),
            "visibility": _not_in("visibility", schema.VISIBILITIES),
        }),
        _repeated(l1, "L1", ["l0_id", "extraction_type", "extractor_version"]),
        l1.join(l0.select(F.col("id").alias("l0_id")), "l0_id", "left_anti").select(
            F.lit("L1").alias("layer"), F.col("id").alias("row_id"), F.lit("l0_id missing").alias("rule")
        ),
        _broken(l2, "L2", {
            "synthesis_type": _not_in("synthesis_type", schema.SYNTHESIS_TYPES),
            "thinking_stage": _not_in("thinking_stage", schema.STAGES),
            "importance": _not_in("importance", schema.IMPORTANCE),
            "visibility": _not_in("visibility", schema.VISIBILITIES),
            "citations": (cited["l0_ids"] == 0) & (cited["l1_ids"] == 0),
        }),
        _repeated(l2, "L2", ["tenant_id", "synthesis_type", "synthesizer_version", "conversation_id"]),
        _broken(l3, "L3", {
            "fusion_type": _not_in("fusion_type", schema.FUSION_TYPES),
            "visibility": _not_in("visibility", schema.VISIBILITIES),
            "citations": cited["l2_ids"] == 0,
        }),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def record_violations(records: DataFrame) -> DataFrame:
    """Extraction records beyond the stated limits: (conversation_id, rule). Input: decode_records."""
    rules = {
        "concepts > 5": F.size("concepts") > 5,
        "edges > 5": F.size("edges") > 5,
        "edge relation": F.exists("edges", lambda e: ~e.getField("relation").isin(schema.RELATIONS)),
        "edge confidence": F.exists("edges", lambda e: (e.getField("confidence") < 0.5) | (e.getField("confidence") > 1.0)),
        "temporal_facts > 3": F.size("temporal_facts") > 3,
        "assets > 3": F.size("assets") > 3,
        "asset kind": F.exists("assets", lambda a: ~a.getField("kind").isin(schema.ASSET_KINDS)),
        "asset content": F.exists("assets", lambda a: F.length(a.getField("content")) <= 20),
        "correction type": F.exists("corrections", lambda c: ~c.getField("correction_type").isin(schema.CORRECTION_TYPES)),
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules.items()]))
    return records.select("conversation_id", F.explode(named).alias("rule"))


def concept_edges(records: DataFrame) -> DataFrame:
    """One row per stated relation between concepts."""
    return records.select("conversation_id", F.explode("edges").alias("e")).select(
        "conversation_id", F.col("e.from").alias("from_concept"), "e.relation", F.col("e.to").alias("to_concept"), "e.confidence"
    )


def concept_degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming relations of every concept."""
    ends = F.explode(
        F.array(
            F.struct(F.col("from_concept").alias("concept"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("to_concept").alias("concept"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    return edges.select(ends.alias("x")).groupBy("x.concept").agg(
        F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree")
    )


def coverage_progress(messages: DataFrame, vectors: DataFrame, s: DataFrame) -> DataFrame:
    """Done, remaining and percent of the embedding and summary steps."""
    spark = messages.sparkSession
    one = spark.range(1)
    rows = []
    users = messages.where("role = 'user'").agg(F.count(F.lit(1))).scalar()
    convs = messages.agg(F.countDistinct("conversation_id")).scalar()
    for step, total, done in [
        ("embedding", users, vectors.agg(F.count(F.lit(1))).scalar()),
        ("summary", convs, s.agg(F.count(F.lit(1))).scalar()),
    ]:
        rows.append(
            one.select(F.lit(step).alias("step"), total.alias("total"), done.alias("done")).select(
                "step", "total", "done",
                F.greatest(F.lit(0), F.col("total") - F.col("done")).alias("remaining"),
                percent(F.col("done"), F.col("total"), 1).alias("percent"),
            )
        )
    return rows[0].unionByName(rows[1])


def _has_items(field: str) -> Column:
    items = F.col(field)
    none = F.exists(items, lambda i: F.contains(i, F.lit(NONE_TEXT)))
    return (F.size(items) > 0) & ~none


def overview(
    messages: DataFrame, vectors: DataFrame, s: DataFrame, repos: DataFrame, commits: DataFrame, docs: DataFrame,
    domains: int = 10,
) -> DataFrame:
    """(metric, value) figures over all tables and the largest domains."""

    def unpivot(one: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in one.columns])
        return one.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")

    parts = [
        messages.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages")),
        vectors.agg(F.count(F.lit(1)).alias("vectors")),
        s.agg(
            F.count(F.lit(1)).alias("summaries"),
            F.count_if(F.col("importance") == "breakthrough").alias("breakthroughs"),
            F.count_if(_has_items("decisions")).alias("with_decisions"),
            F.count_if(_has_items("open_questions")).alias("with_open_questions"),
            F.countDistinct("domain_primary").alias("topics"),
        ),
        repos.agg(F.count(F.lit(1)).alias("repos")),
        commits.agg(F.count(F.lit(1)).alias("commits")),
        docs.agg(F.count(F.lit(1)).alias("docs")),
    ]
    top = (
        s.groupBy("domain_primary").agg(F.count(F.lit(1)).alias("value")).orderBy(F.col("value").desc(), "domain_primary").limit(domains)
        .select(F.concat(F.lit("domain:"), "domain_primary").alias("metric"), "value")
    )
    out = top
    for part in parts:
        out = out.unionByName(unpivot(part))
    return out


def input_status(requirements: dict[str, list[str]], **inputs: DataFrame) -> DataFrame:
    """ok, degraded or unavailable for every operator, from which of its inputs hold rows."""
    spark = next(iter(inputs.values())).sparkSession
    one = spark.range(1)
    rows = []
    filled = {name: df.limit(1).agg(F.count(F.lit(1))).scalar() > 0 for name, df in inputs.items()}
    for operator, needs in requirements.items():
        present = F.lit(0)
        for need in needs:
            if need in filled:
                present = present + filled[need].cast("int")
        status = F.when(present == len(needs), "ok").when(present == 0, "unavailable").otherwise("degraded")
        rows.append(F.struct(F.lit(operator).alias("operator"), F.lit(len(needs)).alias("needs"), present.alias("present"), status.alias("status")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.operator", "r.needs", "r.present", "r.status")
