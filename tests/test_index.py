from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import index as I


@pytest.fixture(scope="module")
def corpus(spark):
    documents = spark.createDataFrame([(1, "drafts/s1/a.md", "drafts", "story1"), (2, "story-plan/s1.md", "story-plan", "story1"), (3, "story-plan/s1b.md", "story-plan", "story1"), (4, "concept/x.md", "concept", None)], "document_id int, path string, doc_type string, story string")
    passages = spark.createDataFrame([
        (1, 1, "林远受伤了，他说没事。阿远和小白并肩走。"), (2, 1, "信号枪裂开，接口亮起。"), (3, 2, "林远接到任务，后来改成护送。"), (4, 2, "小白不是信任他，配合不了。老王在。"), (5, 3, "老王又来了"), (6, 4, "林远"),
    ], "passage_id int, document_id int, text string")
    entities = spark.createDataFrame([(1, "person", "林远", {I.ALIAS_FIELD: "阿远、 "}), (2, "person", "小白", {I.ALIAS_FIELD: "无"}), (3, "items", "信号枪", {}), (4, "person", "老王·铁", {})], "entity_id int, category string, title string, fields map<string,string>")
    named = I.names(entities).cache()
    found = I.mentions(passages, named).cache()
    rows = I.mentioned(found, passages, documents, entities).cache()
    facts = I.facts(I.fact_cues(passages, found), passages, documents, entities).cache()
    return documents, passages, entities, named, found, rows, facts


def test_names_and_mentions(corpus):
    _, passages, _, named, found, *_ = corpus
    assert sorted((r["entity_id"], r["name"]) for r in named.collect()) == sorted([(1, "林远"), (1, "阿远"), (2, "小白"), (3, "信号枪"), (4, "老王·铁"), (4, "老王"), (4, "铁")])
    want = {(p["passage_id"], n["name"]): p["text"].count(n["name"]) for p in passages.collect() for n in named.collect() if n["name"] in p["text"]}
    assert {(r["passage_id"], r["name"]): r["count"] for r in found.collect()} == want


def test_cues_by_plain_search(corpus):
    import re

    _, passages, _, named, _, _, facts = corpus
    want = set()
    for p in passages.collect():
        for s in filter(None, (x.strip() for x in re.split(I.SEGMENT, p["text"]))):
            for n in named.collect():
                for kind, terms in I.CUES.items():
                    for t in terms:
                        if n["name"] in s and t in s and abs(len(s[: s.find(t)].encode()) - len(s[: s.find(n["name"])].encode())) <= I.NEAR and not (kind == "relationship_close" and t in I.NEGATABLE and re.search(I.NEGATED, s)):
                            want.add((p["passage_id"], n["entity_id"], n["name"], kind, t))
    assert {(r["passage_id"], r["entity_id"], r["name"], r["fact_type"], r["cue"]) for r in facts.collect()} == want and len(want) >= 7


def test_tensions_and_conflicts(spark, corpus):
    documents, passages, _, _, _, rows, facts = corpus
    assert [tuple(r)[1:] for r in I.tensions(facts, "equipment").select("story", "title", "equipment_damaged", "equipment_active").collect()] == [("信号枪", "裂开", "亮起,接口")]
    goal = I.tensions(facts, "goal").first()
    assert (goal["goal_assigned"], goal["goal_changed"], goal["goal_completed"]) == ("任务", "改成", "")
    assert I.tensions(facts, "relationship").count() == 0 and I.fact_table(facts, "story1").count() >= 2
    gaps = I.alignment_gaps(rows).first()
    assert (gaps["plan_entities"], gaps["draft_entities"], gaps["plan_only"], gaps["draft_only"]) == (3, 3, ["老王·铁"], ["信号枪"])
    drift = {r["title"]: (r["plan_names"], r["draft_names"]) for r in I.alias_drift(rows).collect()}
    assert drift == {"林远": (["林远"], ["林远", "阿远"])}
    kinds = sorted((r["kind"], r["title"]) for r in I.suspects(rows).collect())
    assert kinds == [("alias_drift", "林远"), ("alias_mixing", "林远"), ("plan_only", "老王·铁")]
    found = I.conflicts(facts, rows)
    got = [(r["category"], r["title"], r["confidence"]) for r in found.collect()]
    assert got == [("alias_register_drift", "林远", "medium"), ("equipment_state_jump", "信号枪", "medium"), ("injury_state_jump", "林远", "medium"), ("plan_draft_entity_drift", "-", "medium")]
    assert found.where("category = 'equipment_state_jump'").first()["summary"] == "equipment=裂开 -> 亮起,接口" and I.conflicts(facts, rows, 2).count() == 2
    history = I.decide(found, "equipment_state_jump", "story1", "信号枪", "watch", "voice").withColumn("seq", F.lit(1)).unionByName(I.decide(found, "equipment_state_jump", "story1", "信号枪", "confirmed").withColumn("seq", F.lit(2))).cache()
    told = I.with_feedback(found, history)
    assert {r["title"]: r["decision"] for r in told.where("decision IS NOT NULL").collect()} == {"信号枪": "confirmed"}
    counts = {(r["counter"], r["name"]): r["n"] for r in I.feedback_counts(told).collect()}
    assert counts == {("decision", "confirmed"): 1, ("category", "equipment_state_jump::confirmed"): 1, ("story", "story1::confirmed"): 1, ("unresolved", "story1"): 3}
    assert {r["decision"]: (r["name"], r["n"]) for r in I.backlog(history).collect()} == {"watch": ("story1", 1), "confirmed": ("story1", 1)}
    assert I.of_story(history, "x").count() == 0 and I.of_story(history, None).count() == 2
    with pytest.raises(Exception, match="several"):
        I.decide(found.union(found), "equipment_state_jump", "story1", "信号枪", "watch").collect()
    assert [(r["left"], r["right"]) for r in I.pairs(rows, passages).collect()] == [("小白", "林远")]


def test_search_and_canon(spark):
    documents = spark.createDataFrame([(1, "b.md", "drafts"), (2, "a.md", "drafts")], "document_id int, path string, doc_type string")
    passages = spark.createDataFrame([(1, 1, "Red fox runs"), (2, 2, "fox red"), (3, 2, "red dog")], "passage_id int, document_id int, text string")
    assert [r["passage_id"] for r in I.search(passages, documents, "RED fox", 5).collect()] == [2, 1] and I.search(passages, documents, "!", 5).collect() == []
    canon = spark.createDataFrame([("c1", "Ann", "alive", False, None), ("c2", "Ann", "eyes", False, "blue")], "canon_id string, subject string, predicate string, negated boolean, value string")
    events = spark.createDataFrame([("e1", "Ann", "alive", True, None), ("e2", "Ann", "eyes", False, "green"), ("e3", "Bob", "alive", True, None)], "event_id string, subject string, predicate string, negated boolean, value string")
    assert sorted((r["canon_id"], r["event_id"], r["kind"]) for r in I.canon_conflicts(canon, events).collect()) == [("c1", "e1", "negation"), ("c2", "e2", "value")]
