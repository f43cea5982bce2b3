"""Properties and edge cases of the operators that the tables do not show."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colloquy import schema
from colloquy.operators import domain_state, facts, links, quality, search, timeline
from colloquy.plans import derive

DIR = "/root/testdata/sf0.001"
SUMMARY = "conversation_id string, domain_primary string, importance string, thinking_stage string, open_questions array<string>, concepts array<string>, summarized_at timestamp"


def summaries(spark, rows):
    return schema.conform(spark.createDataFrame(rows, SUMMARY), schema.SUMMARIES)


def test_one_topic_equals_its_part_of_a_batch(spark):
    t = derive.turns(spark, DIR)
    batch = search.kw_search(t, ["python", "the", "database"]).where("topic = 'the'").collect()
    assert sorted(batch) == sorted(search.kw_search(t, ["the"]).collect())


def test_input_layout_does_not_matter(spark):
    t = derive.turns(spark, DIR)
    mixed = t.repartition(13).select(*reversed(t.columns))
    for run in (lambda x: search.positions(x, ["the"]), lambda x: search.tunnel_recent(x, ["the"]), search.open_turns):
        assert sorted(run(t).collect()) == sorted(run(mixed).collect())


def test_stage_is_the_newest_not_the_largest(spark):
    at = datetime(2025, 1, 1)
    s = summaries(spark, [("a", "d", "significant", "refining", ["q"], [], at), ("b", "d", "routine", "exploring", ["q", "r"], [], at + timedelta(days=1))])
    row = domain_state.dormant(s).first()
    assert (row.stage, row.n_questions, row.questions) == ("exploring", 2, ["q", "r"])
    assert domain_state.dormant(s, "breakthrough").count() == 0


def test_blank_importance_does_not_fail(spark):
    s = summaries(spark, [("a", "d", None, None, ["q"], [], datetime(2025, 1, 1))])
    assert domain_state.dormant(s).count() == 0 and domain_state.dormant(s, "routine").count() == 0


def test_switch_cost_value(spark):
    at = datetime(2025, 1, 1)
    s = summaries(spark, [("a", "x", "routine", "executing", [f"q{i}" for i in range(20)], ["c1", "c2"], at), ("b", "y", "routine", "exploring", [], ["c2"], at)])
    cost = domain_state.switch_cost(s, spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "none")], "current string, target string"))
    got = {(r.current, r.target): (r.score, r.band, r.shared) for r in cost.collect()}
    assert got == {("x", "y"): (0.48, "moderate", 1), ("y", "x"): (0.0, "low", 1)}


def test_domain_state_orders_newest_first(spark):
    at = datetime(2025, 1, 1)
    rows = [(f"c{i:02d}", "d", "routine", "exploring", [f"q{i}", "None identified", "shared"], [], at + timedelta(hours=i)) for i in range(30)]
    row = domain_state.domain_state(summaries(spark, rows).repartition(5), n=3).first()
    assert row.open_questions == ["q29", "shared", "q28", "q27"] and row.conversations == 30 and row.n_open_questions == 31


def test_transcript_cap_is_exact_for_long_conversations(spark):
    rows = [("c", i, "user", "ab", "s", "T", f"m{i}") for i in range(6000)] + [("d", 0, "user", "short", "s", "T", "x")]
    m = spark.createDataFrame(rows, "conversation_id string, msg_index int, role string, content string, source string, conversation_title string, message_id string")
    out = timeline.transcripts(m.repartition(6), cap=15_000).collect()
    assert len(out) == 1 and out[0].msg_count == 6000
    assert out[0].text == "\n\n".join("user: ab" for _ in range(6000))[:15000]


def test_visibility(spark):
    rows = spark.createDataFrame([(1, "t1", "me", "private"), (2, "t1", "you", "tenant"), (3, "t2", "you", "tenant"), (4, "t2", "you", "public"), (5, "t1", "you", "private")],
                                 "id int, tenant_id string, owner_user_id string, visibility string")
    members = spark.createDataFrame([("t1", "me"), ("t1", "me"), ("t2", "you")], "tenant_id string, user_id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.visible_rows(rows, members, "me")) == [1, 2, 4]
    assert ids(search.visible_rows(rows, members, "me", public=False)) == [1, 2]
    assert ids(search.visible_rows(rows, members, "nobody")) == [4]


def test_alignment_takes_the_first_principles(spark):
    d = spark.createDataFrame([("d1", "Should we simplify everything"), ("d2", "a to b")], "decision_id string, decision string")
    p = spark.createDataFrame([(i, f"P{i}", "Always SIMPLIFY things", None, None) for i in range(5)],
                              "position int, name string, definition string, description string, formula string")
    assert [(r.decision_id, r.name) for r in links.alignment(d, p).orderBy("rank").collect()] == [("d1", "P0"), ("d1", "P1"), ("d1", "P2")]


def test_record_rules_and_edges(spark):
    edges = [{"from": "a", "to": "b", "relation": "implements", "confidence": 0.9}, {"from": "a", "to": "c", "relation": "causes", "confidence": 0.9}]
    from colloquy.sources.summaries import decode_records
    import json

    lines = spark.createDataFrame([(json.dumps({"conversation_id": "c", "data": {"edges": edges, "temporal_facts": [{}] * 4}}),)], "value string")
    decoded = decode_records(lines)
    assert sorted(r.rule for r in quality.record_violations(decoded).collect()) == ["edge relation", "temporal_facts > 3"]
    degrees = {r.concept: (r.out_degree, r.in_degree) for r in quality.concept_degrees(quality.concept_edges(decoded)).collect()}
    assert degrees == {"a": (2, 0), "b": (0, 1), "c": (0, 1)}


def test_tech_months(spark):
    m = spark.createDataFrame([(datetime(2025, 1, 5), "I use Python and SQL"), (datetime(2025, 2, 5), "python with Docker, docker!"), (datetime(2025, 2, 6), "pythonic")], "created timestamp, content string")
    rows = facts.tech_stacks(m).orderBy("month_start").collect()
    assert [(r.all_techs, r.new_adoptions, r.abandonments) for r in rows] == [(["python", "sql"], ["python", "sql"], []), (["docker", "python"], ["docker"], ["sql"])]


def test_open_turns_as_of(spark):
    t = spark.createDataFrame([(datetime(2025, 1, 1), "s", "c", "user", "is it done?", "1"), (datetime(2025, 1, 20), "s", "c", "user", "Still need tests", "2"), (datetime(2025, 1, 20), "s", "c", "assistant", "really?", "3")],
                              "ts timestamp, src string, conv_id string, role string, text string, message_id string")
    assert [r.text for r in search.open_turns(t).collect()] == ["Still need tests"]
    assert [r.text for r in search.open_turns(t, as_of="2025-01-03", days=5).orderBy(F.col("ts")).collect()] == ["is it done?", "Still need tests"]


def test_position_raw_full_has_hits_by_meaning(spark):
    from collections import Counter

    from colloquy.plans import queries

    kinds = Counter((r.topic, r.kind) for r in queries.queries()["position_raw_full"](spark, "/root/testdata/sf0.001").collect())
    assert all(kinds[t, "semantic"] == 10 for t in queries.TOPICS)
