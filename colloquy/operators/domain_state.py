"""State, history and cost of domains from conversation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions.jsonlist import real_item, real_items
from colloquy.functions.text import cite, percent, preview
from colloquy.operators.ranking import in_slices, top_per

NAMED = "domain_primary <> ''"


def is_breakthrough() -> Column:
    return F.col("importance") == "breakthrough"


def newest_first() -> list[Column]:
    return [F.col("summarized_at").desc(), F.col("conversation_id")]


# Cost of leaving a domain at a stage, and of an unknown stage.
STAGE_COST = {"executing": 0.8, "refining": 0.6, "crystallizing": 0.4, "exploring": 0.2}
UNKNOWN_STAGE_COST = 0.3


def importance_rank(c: Column) -> Column:
    """breakthrough 3, significant 2, routine 1, anything else 0."""
    return F.when(c == "breakthrough", 3).when(c == "significant", 2).when(c == "routine", 1).otherwise(0)


def latest_by(c: str) -> Column:
    """Value of the newest summary."""
    return F.max_by(c, F.struct("summarized_at", "conversation_id"))


def items(s: DataFrame, field: str, mode: str = "equals") -> DataFrame:
    """(domain_primary, item, order): distinct list entries per domain, newest summary first.

    Equal entries merge before the shuffle, so a domain with many summaries sends one row per
    distinct entry and task.
    """
    seen = F.struct((-F.unix_micros("summarized_at")).alias("age"), F.col("conversation_id"), F.col("pos"))
    exploded = s.select("domain_primary", "summarized_at", "conversation_id", F.posexplode(field).alias("pos", "item"))
    return (
        exploded.where(real_item(F.col("item"), mode))
        .groupBy("domain_primary", "item")
        .agg(F.min(seen).alias("seen"), F.count(F.lit(1)).alias("n"))
    )


def item_heads(found: DataFrame, n: int, name: str) -> DataFrame:
    """Number of distinct entries per domain, and the first n of them joined in order."""
    totals = found.groupBy("domain_primary").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    heads = (
        top_per(found, ["domain_primary"], [F.col("seen")], n)
        .groupBy("domain_primary")
        .agg(F.sort_array(F.collect_list(F.struct("seen", "item"))).alias("_h"))
        .select("domain_primary", F.transform("_h", lambda h: h.getField("item")).alias(name))
    )
    return totals.join(heads, "domain_primary")


def domain_map(s: DataFrame) -> DataFrame:
    """Conversations per domain, important ones among them, and the share of all."""
    total = s.agg(F.count(F.lit(1))).scalar()
    return s.groupBy("domain_primary").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_breakthrough()).alias("breakthroughs"),
        F.count_if(F.col("importance") == "significant").alias("significant"),
    ).withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 1))


def distributions(s: DataFrame) -> DataFrame:
    """Counts of summaries by source, importance, domain and stage."""
    pair = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("attribute"), F.col(column).alias("value"))
                for name, column in [
                    ("source", "source"), ("importance", "importance"),
                    ("domain", "domain_primary"), ("stage", "thinking_stage"),
                ]
            ]
        )
    )
    return s.select(pair.alias("p")).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("n"))


def top_concepts(s: DataFrame, domains: int = 5, n: int = 8) -> DataFrame:
    """Most frequent concepts of the largest domains, over all their summaries."""
    largest = s.groupBy("domain_primary").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "domain_primary").limit(domains)
    counted = (
        s.join(largest.select("domain_primary"), "domain_primary", "left_semi")
        .select("domain_primary", F.explode("concepts").alias("concept"))
        .where(F.col("concept") != "")
        .groupBy("domain_primary", "concept")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per(counted, ["domain_primary"], [F.col("n").desc(), F.col("concept")], n, "position")


def pulse(s: DataFrame, domain: str | None = None, limit: int = 25) -> DataFrame:
    """Stages per domain with totals and the ready-to-ship and still-exploring classes."""
    rows = s.where("thinking_stage IS NOT NULL")
    if domain:
        rows = rows.where(F.col("domain_primary") == domain)
        return rows.groupBy("thinking_stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_breakthrough()).alias("breakthroughs"))
    per = rows.groupBy("domain_primary").agg(
        *[F.count_if(F.col("thinking_stage") == stage).alias(stage) for stage in schema.STAGES],
        F.count(F.lit(1)).alias("total"),
    )
    expl, cryst = F.col("exploring"), F.col("crystallizing")
    others = cryst + F.col("refining") + F.col("executing")
    return (
        per.withColumn("ready_to_ship", (cryst > expl) & (cryst > 0))
        .withColumn("still_exploring", (expl > others) & (expl > 0))
        .orderBy(F.col("total").desc(), "domain_primary")
        .limit(limit)
    )


def _merged(rows: Column, field: str, mode: str) -> Column:
    return F.array_distinct(real_items(F.flatten(F.transform(rows, lambda r: F.coalesce(r.getField(field), F.array().cast("array<string>")))), mode))


def _newest_rows(s: DataFrame, n: int, fields: list[str]) -> DataFrame:
    """The n newest summaries of every domain as one ordered array per domain."""
    kept = top_per(s.where(NAMED), ["domain_primary"], newest_first(), n, "_r")
    return kept.groupBy("domain_primary").agg(F.sort_array(F.collect_list(F.struct("_r", *fields))).alias("rows"))


def _totals(s: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exact counts per domain over all its summaries: conversations, important ones, `stage:count`, distinct entries of each list.

    The summaries are read once: a row becomes its entries, named by their field, and equal ones are counted before the shuffle.
    """
    def entry(field: str, item: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), item.alias("item"))

    def flag(field: str, holds: Column) -> Column:
        return F.when(holds, F.array(entry(field, F.lit("")))).otherwise(F.array().cast("array<struct<field:string,item:string>>"))

    def listed(field: str, mode: str) -> Column:
        return F.transform(real_items(F.col(field), mode), lambda item: entry(f"n_{field}", item))

    entries = F.concat(
        F.array(entry("stage", F.coalesce("thinking_stage", F.lit("")))), flag("breakthroughs", is_breakthrough()),
        flag("significant", F.col("importance") == "significant"), *[listed(f, mode) for f, mode in fields.items()],
    )
    counted = (
        s.where(NAMED).select("domain_primary", F.inline(entries)).groupBy("domain_primary", "field", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def of(field: str) -> Column:
        return F.col("field") == field

    def total(field: str) -> Column:
        return F.coalesce(F.sum(F.when(of(field), F.col("n"))), F.lit(0))

    stages = F.sort_array(F.collect_list(F.when(of("stage"), F.struct("item", "n"))))
    return counted.groupBy("domain_primary").agg(
        total("stage").alias("conversations"), total("breakthroughs").alias("breakthroughs"), total("significant").alias("significant"),
        F.transform(stages, lambda x: F.concat_ws(":", x["item"], x["n"].cast("string"))).alias("stage_counts"),
        *[F.count_if(of(f"n_{f}")).alias(f"n_{f}") for f in fields],
    )


def domain_state(s: DataFrame, n: int = 10) -> DataFrame:
    """Where each domain was left: heads of the merged lists of its n newest summaries, its latest attributes, counts over all."""
    lists = ["open_questions", "decisions", "concepts", "key_insights", "connections_to"]
    plain = ["thinking_stage", "emotional_tone", "cognitive_pattern", "problem_solving_approach",
             "title", "conversation_id", "summarized_at"]
    rows = F.col("rows")
    first = F.element_at(rows, 1)
    base = _newest_rows(s, n, lists + plain)
    merged = base.select(
        "domain_primary", "rows",
        *[_merged(rows, f, "equals" if f == "open_questions" else "any").alias(f"_{f}") for f in lists],
    )

    def unknown(field: str) -> Column:
        value = first.getField(field)
        return F.when(value != "", value).otherwise(F.lit("unknown"))

    sources = F.transform(
        "rows", lambda r: F.concat_ws(" ", F.left(F.coalesce(r.getField("title"), F.lit("Untitled")), F.lit(50)),
                                      cite(r.getField("conversation_id"), r.getField("summarized_at"))))
    totals = _totals(s, {"open_questions": "equals", "decisions": "any", "concepts": "any"})
    return merged.join(totals, "domain_primary").select(
        "domain_primary",
        "conversations",
        unknown("thinking_stage").alias("stage"),
        unknown("emotional_tone").alias("tone"),
        unknown("cognitive_pattern").alias("pattern"),
        unknown("problem_solving_approach").alias("approach"),
        "breakthroughs",
        "significant",
        "n_open_questions",
        F.slice("_open_questions", 1, 10).alias("open_questions"),
        "n_decisions",
        F.slice("_decisions", 1, 7).alias("decisions"),
        "n_concepts",
        F.slice(F.array_sort("_concepts"), 1, 15).alias("concepts"),
        F.slice("_key_insights", 1, 5).alias("insights"),
        F.slice(F.array_sort("_connections_to"), 1, 10).alias("connections"),
        "stage_counts",
        sources.alias("sources"),
    )


def domain_brief(s: DataFrame, n: int = 5) -> DataFrame:
    """Re-entry brief of each domain from its n+10 newest summaries; counts are over all."""
    fields = ["open_questions", "decisions", "key_insights", "quotable", "thinking_stage", "emotional_tone"]
    rows = F.col("rows")
    first = F.element_at(rows, 1)
    merged = _newest_rows(s, n + 10, fields).select(
        "domain_primary",
        first.getField("thinking_stage").alias("stage"),
        first.getField("emotional_tone").alias("tone"),
        _merged(rows, "open_questions", "equals").alias("_q"),
        _merged(rows, "decisions", "any").alias("_d"),
        _merged(rows, "key_insights", "any").alias("_i"),
        _merged(rows, "quotable", "any").alias("_u"),
    )
    return merged.join(_totals(s, {"open_questions": "equals"}), "domain_primary").select(
        "domain_primary", "conversations", "stage", "tone", "n_open_questions",
        F.slice("_q", 1, 10).alias("open_questions"),
        F.slice("_d", 1, 7).alias("decisions"),
        F.slice("_i", 1, 5).alias("insights"),
        F.left(F.get("_u", F.lit(0)), F.lit(200)).alias("quote"),
    )


def domain_brief_items(s: DataFrame, n: int = 5) -> DataFrame:
    """The n newest summaries of each domain, with a citation for each."""
    return top_per(s.where(NAMED), ["domain_primary"], newest_first(), n, "position").select(
        "domain_primary", "position", F.left("title", F.lit(60)).alias("title"), "source", "msg_count", "importance",
        preview(F.col("summary"), 300).alias("summary"),
        cite(F.col("conversation_id"), F.col("summarized_at")).alias("citation"),
    )


def dormant(s: DataFrame, min_importance: str = "significant", limit: int = 20, shown: int = 5) -> DataFrame:
    """Domains important enough that still have open questions."""
    floor = {"breakthrough": 3, "significant": 2, "routine": 1}.get(min_importance, 1)
    named = s.where(NAMED)
    per = named.groupBy("domain_primary").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.count_if(is_breakthrough()).alias("breakthroughs"),
        F.max(importance_rank(F.col("importance"))).alias("_rank"),
        latest_by("thinking_stage").alias("stage"),
    )
    heads = item_heads(items(named, "open_questions"), shown, "questions")
    order = [F.col("breakthroughs").desc(), F.col("n_questions").desc(), F.col("conversations").desc(), F.col("domain_primary")]
    return (
        per.where(F.col("_rank") >= floor).drop("_rank").join(heads, "domain_primary").orderBy(*order).limit(limit)
    )


def open_threads(s: DataFrame, per_domain: int = 5, domains: int = 20) -> DataFrame:
    """Open questions of every domain, the domains with most breakthroughs and questions first."""
    named = s.where(NAMED)
    per = named.groupBy("domain_primary").agg(
        F.count(F.lit(1)).alias("conversations"), F.count_if(is_breakthrough()).alias("breakthroughs")
    )
    heads = item_heads(items(named, "open_questions"), per_domain, "questions")
    order = [F.col("breakthroughs").desc(), F.col("n_questions").desc(), F.col("domain_primary")]
    return per.join(heads, "domain_primary").orderBy(*order).limit(domains)


# Attributes of the history tables: (name, column, default for blanks, entries kept).
_HISTORY = [
    ("stage", "thinking_stage", "unknown", None),
    ("importance", "importance", "routine", None),
    ("source", "source", None, None),
    ("pattern", "cognitive_pattern", None, 7),
    ("approach", "problem_solving_approach", None, 7),
    ("tone", "emotional_tone", None, 5),
]


def _pairs(spec) -> Column:
    """Array of (attribute, value) pairs of one summary, blanks replaced or left out."""
    out = []
    for name, column, default, _ in spec:
        value = F.when(F.col(column) != "", F.col(column))
        if default:
            value = F.coalesce(value, F.lit(default))
        out.append(F.struct(F.lit(name).alias("attribute"), value.alias("value")))
    return F.filter(F.array(*out), lambda p: p.getField("value").isNotNull())


def domain_history(s: DataFrame, concepts: int = 10) -> DataFrame:
    """Frequency of each stage, importance, source, pattern, approach, tone and concept per domain."""
    named = s.where(NAMED)
    tags = F.transform(
        F.coalesce("concepts", F.array().cast("array<string>")),
        lambda c: F.struct(F.lit("concept").alias("attribute"), c.alias("value")),
    )
    counted = (
        named.select("domain_primary", F.explode(F.concat(_pairs(_HISTORY), tags)).alias("p"))
        .groupBy("domain_primary", "p.attribute", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = named.groupBy("domain_primary").agg(F.count(F.lit(1)).alias("conversations"))
    # Attributes of any number of values are cut before the shuffle; the others hold a few enumerated values.
    limits = {"concept": concepts} | {name: keep for name, _, _, keep in _HISTORY if keep}
    keys, order = ["domain_primary", "attribute"], [F.col("n").desc(), F.col("value")]
    cut = F.col("attribute").isin(list(limits))
    heads = top_per(counted.where(cut), keys, order, max(limits.values()), "position")
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("attribute"))
    whole = counted.where(~cut).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = heads.where(F.col("position") <= limit).unionByName(whole)
    return kept.join(totals, "domain_primary").select(
        "domain_primary", "attribute", "value", "n", "position", "conversations",
        percent(F.col("n"), F.col("conversations"), 1).alias("pct"),
    )


def domain_switches(s: DataFrame) -> DataFrame:
    """Distinct (current, target) pairs of domains that follow one another in a source's summaries.

    The previous summary is looked up inside even ranges of the table; the last domain of each is carried into the source's
    next, so no source, day or second has to fit into one task. Runs a job when called.
    """
    named = s.where(NAMED).select("source", "summarized_at", "conversation_id", "domain_primary")
    named = in_slices(named, ["source", "summarized_at", "conversation_id"])
    inside = Window.partitionBy("source", "_slice").orderBy("_row")
    ends = named.groupBy("source", "_slice").agg(F.max_by("domain_primary", "_row").alias("_end"))
    before = ends.select(
        F.col("source").alias("_s"), F.col("_slice").alias("_b"),
        F.lag("_end").over(Window.partitionBy("source").orderBy("_slice")).alias("_carried"),
    )
    return (
        named.withColumn("_prev", F.lag("domain_primary").over(inside))
        .join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_b")))
        .select(F.coalesce("_prev", "_carried").alias("current"), F.col("domain_primary").alias("target"))
        .where("current IS NOT NULL AND current <> target")
        .distinct()
    )


def switch_cost(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cost 0..1 of leaving `current` for `target`, for every given pair."""
    per = s.groupBy("domain_primary").agg(F.count(F.lit(1)).alias("conversations"), latest_by("thinking_stage").alias("stage"))
    questions = items(s, "open_questions").groupBy("domain_primary").agg(F.count(F.lit(1)).alias("questions"))
    concepts = s.select("domain_primary", F.explode("concepts").alias("concept")).distinct()
    sizes = concepts.groupBy("domain_primary").agg(F.count(F.lit(1)).alias("concepts"))
    facts = per.join(questions, "domain_primary", "left").join(sizes, "domain_primary", "left").na.fill(0, ["questions", "concepts"])
    asked = pairs.select("current", "target").distinct()
    of_current = asked.join(concepts.withColumnRenamed("domain_primary", "current"), "current")
    shared = of_current.join(
        concepts.withColumnRenamed("domain_primary", "target"), ["target", "concept"], "left_semi"
    ).groupBy("current", "target").agg(F.count(F.lit(1)).alias("shared"))
    cur = facts.select(
        F.col("domain_primary").alias("current"), F.col("stage"), F.col("questions"), F.col("concepts").alias("current_concepts")
    )
    tgt = facts.select(
        F.col("domain_primary").alias("target"), F.col("conversations").alias("target_conversations"),
        F.col("concepts").alias("target_concepts"),
    )
    rows = asked.join(cur, "current").join(tgt, "target").join(shared, ["current", "target"], "left")
    rows = rows.na.fill(0, ["shared"])
    stage_cost = F.lit(UNKNOWN_STAGE_COST)
    for stage, cost in STAGE_COST.items():
        stage_cost = F.when(F.col("stage") == stage, F.lit(cost)).otherwise(stage_cost)
    question_cost = F.least(F.col("questions") / 10.0, F.lit(1.0))
    discount = F.least(F.col("shared") / F.greatest("current_concepts", F.lit(1)), F.lit(1.0))
    raw = F.round(question_cost * 0.35 + stage_cost * 0.35 - discount * 0.3, 3)
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).select(
        "current", "target", F.coalesce("stage", F.lit("unknown")).alias("stage"), "questions",
        "current_concepts", "target_conversations", "target_concepts", "shared", "score", band("score").alias("band"),
    )


def band(score: str) -> Column:
    return F.when(F.col(score) < 0.3, "low").when(F.col(score) < 0.6, "moderate").otherwise("high")


_PATTERNS = [
    ("pattern", "cognitive_pattern", None, 10),
    ("approach", "problem_solving_approach", None, 10),
    ("tone", "emotional_tone", None, 8),
    ("category", "content_category", None, 8),
]


def patterns(s: DataFrame, by_domain: bool = False, domain: str | None = None) -> DataFrame:
    """Frequency and breakthroughs of patterns, approaches, tones and categories.

    `best` marks the value of each attribute with most breakthroughs.
    """
    rows = s.where(F.col("domain_primary") == domain) if domain else s
    scope = F.col("domain_primary") if by_domain else F.lit(domain or "(all)")
    rows = rows.withColumn("scope", scope)
    counted = (
        rows.select("scope", "importance", F.explode(_pairs(_PATTERNS)).alias("p"))
        .groupBy("scope", "p.attribute", "p.value")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_breakthrough()).alias("breakthroughs"))
    )
    keys = ["scope", "attribute"]
    limits = {name: keep for name, _, _, keep in _PATTERNS}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("attribute"))
    heads = top_per(counted, keys, [F.col("n").desc(), F.col("value")], max(limits.values()), "position").where(F.col("position") <= limit)
    order = [F.col("breakthroughs").desc(), F.col("n").desc(), F.col("value")]
    best = top_per(counted.where("breakthroughs > 0"), keys, order, 1)
    named = best.select(*keys, F.col("value").alias("_value"), F.col("n").alias("_n"))
    ahead = (F.col("n") > F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("value") < F.col("_value")))
    places = counted.join(named, keys).groupBy(*keys).agg((F.count_if(ahead) + 1).cast("int").alias("position"))
    shown = heads.join(named.drop("_n"), keys, "left").withColumn("best", F.coalesce(F.col("value") == F.col("_value"), F.lit(False))).drop("_value")
    missed = best.join(places, keys).where(F.col("position") > limit).withColumn("best", F.lit(True))
    out = shown.unionByName(missed)
    totals = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("conversations"))
    if by_domain:
        out = out.join(totals, "scope")
    else:
        out = out.withColumn("conversations", totals.select("conversations").scalar())
    return out.select(
        "scope", "attribute", "value", "n", "breakthroughs", "position", "best",
        percent(F.col("n"), F.col("conversations"), 1).alias("pct"),
    )


def coverage(s: DataFrame) -> DataFrame:
    """What the summaries preserve, each figure with its status."""
    questions = F.size(real_items(F.col("open_questions")))
    one = s.agg(
        F.count(F.lit(1)).alias("conversations"),
        F.countDistinct("domain_primary").alias("domains"),
        F.count_if(is_breakthrough()).alias("breakthroughs"),
        F.sum(questions.cast("long")).alias("open_questions"),
        F.sum(F.size("decisions").cast("long")).alias("decisions"),
        F.countDistinct(F.when(questions > 0, F.col("domain_primary"))).alias("domains_with_questions"),
    )
    return one.select(
        "*",
        F.when(F.col("conversations") > 5000, "good").otherwise("partial").alias("coverage_status"),
        F.when(F.col("domains") > 15, "good").otherwise("partial").alias("breadth_status"),
        F.when(F.col("breakthroughs") > 10, "good").otherwise("partial").alias("depth_status"),
        F.when(F.col("domains_with_questions") > 10, "attention").otherwise("good").alias("threads_status"),
    )


def domain_coverage(s: DataFrame, limit: int = 15) -> DataFrame:
    """Largest domains with their latest stage, breakthroughs and whether questions are open."""
    questions = F.size(real_items(F.col("open_questions"))) > 0
    return (
        s.where(NAMED)
        .groupBy("domain_primary")
        .agg(
            F.count(F.lit(1)).alias("n"),
            latest_by("thinking_stage").alias("stage"),
            F.count_if(is_breakthrough()).alias("breakthroughs"),
            F.max(questions).alias("has_open_questions"),
        )
        .orderBy(F.col("n").desc(), "domain_primary")
        .limit(limit)
    )


def unfinished(
    s: DataFrame, domain: str | None = None, min_importance: str = "significant", limit: int = 25, shown: int = 3
) -> DataFrame:
    """Early-stage conversations that still have real open questions."""
    floor = {"breakthrough": 3, "significant": 2, "routine": 0}.get(min_importance, 2)
    rank = importance_rank(F.col("importance"))
    rows = s.where(F.col("thinking_stage").isin("exploring", "crystallizing") & (rank >= floor))
    if domain:
        rows = rows.where(F.col("domain_primary") == domain)
    rows = rows.withColumn("_q", real_items(F.col("open_questions"), "contains")).where(F.size("_q") > 0)
    return (
        rows.orderBy(rank.desc(), F.col("msg_count").desc(), "conversation_id")
        .limit(limit)
        .select(
            "conversation_id", "title", "source", "domain_primary", "thinking_stage", "importance", "msg_count",
            F.left("summary", F.lit(200)).alias("summary"),
            F.size("_q").cast("long").alias("n_questions"),
            F.slice(F.transform("_q", lambda q: F.left(q, F.lit(200))), 1, shown).alias("questions"),
        )
    )
