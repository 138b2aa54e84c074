from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import audit as A

LEX = A.Lexicon(labels={})


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "他走了。她来了！好。\n“你好？”他说：“走。”\n\n显然，他其实把门关上了，然后走了，于是笑了，又哭了。\n张三：走吗？\n李四：走。"
    return spark.createDataFrame([(1, text), (2, ""), (3, "短。" * 9)], "doc_id int, text string")


def test_sentences_and_profile(docs):
    rows = A.sentences(docs).cache()
    first = [(r["idx"], r["line_no"], r["text"], r["chars"]) for r in rows.where("doc_id = 1").orderBy("idx").collect()]
    assert first[:3] == [(1, 1, "他走了。", 3), (2, 1, "她来了！", 3), (3, 1, "好。", 1)] and first[3][1] == 2
    assert rows.where("doc_id = 2").count() == 0
    p = {r["doc_id"]: r for r in A.length_profile(rows, LEX).collect()}
    assert (p[3]["sentences"], p[3]["shortest"], p[3]["short"]) == (9, 1, 1.0)
    assert [(r["first"], r["last"], r["length"]) for r in A.short_runs(rows.where("doc_id = 3"), LEX).collect()] == [(1, 9, 9)]
    windows = A.fatigue_windows(rows.where("doc_id = 3"), LEX).collect()
    assert [(r["first"], r["last"], r["score"], r["reasons"]) for r in windows] == [(1, 5, 15, ["short", "very_short"])]
    assert len(A.fatigue_windows(rows.where("doc_id = 3 AND idx <= 4"), LEX).collect()) == 1 and A.fatigue_windows(rows.where("doc_id = 3 AND idx <= 3"), LEX).count() == 0


def test_paragraphs_and_dialogue(docs):
    rows = A.paragraphs(docs).cache()
    assert [(r["line_start"], r["line_end"], r["dialogue"]) for r in rows.where("doc_id = 1").orderBy("idx").collect()] == [(1, 2, True), (4, 6, False)]
    assert A.dialogue_runs(rows, 1).count() == 1 and A.dialogue_runs(rows, 1, most_chars=2).count() == 0
    lines = A.sentences(docs)
    assert {(r["speaker"], r["lines"]) for r in A.voices(lines).collect()} >= {("张三", 1), ("李四", 1)}
    assert [(r["speaker"], r["other"]) for r in A.alike(A.voices(lines).where("speaker IN ('张三', '李四')"), 5.0, 1.0, 1).collect()] == [("张三", "李四")]


def test_densities(docs):
    rows = {(r["doc_id"], r["name"]): r for r in A.rule_density(docs, [("go", "走", 10.0), ("none", "zzz", 1.0)]).collect()}
    assert rows[1, "go"]["count"] == 5 and rows[1, "go"]["warn"] and rows[1, "none"]["count"] == 0 and rows[2, "go"]["per_10k"] == 0.0 and rows[1, "go"]["samples"][0].startswith("他走了")
    terms = A.term_metrics(docs, [("move", "走", 1.0), ("move", "来", 1.0), ("feel", "笑", 1.0)])
    cats = {(r["doc_id"], r["category"]): (r["count"], r["top"]) for r in A.by_category(terms).collect()}
    assert cats == {(1, "move"): (6, ["走", "来"]), (1, "feel"): (1, ["笑"])}
    assert A.named_metrics(A.rule_density(docs, [("go", "走", 1.0), ("x", "走", 1.0)]), ["go"]).count() == 1
    assert [r["term"] for r in A.learned_metrics(docs, [("走", 1.0), ("笑", 1.0)]).collect()] == ["走"]


def test_grams_leads_and_clauses(spark, docs):
    d = spark.createDataFrame([(1, "月光落下，月光落下，月光落下，月色")], "doc_id int, text string")
    assert {(r["gram"], r["count"]) for r in A.ngrams(d, {2: 3, 3: 3, 4: 3}).collect()} == {("月光落下", 3)}
    assert {r["gram"] for r in A.ngrams(d, {2: 3, 4: 3}, ("落",)).collect()} == {"月光"}
    rows = A.sentences(docs)
    assert {(r["lead"], r["n"]) for r in A.leads(rows, ("他", "她"), 1).where("doc_id = 1").collect()} == {("他", 2), ("她", 1)} and A.starts(rows, 1, 9).first()["start"] == "短"
    s = A.sentences(spark.createDataFrame([(1, "走过来看，走过来听，走过来问，走过来想。高高兴兴，来来往往，明明白白。")], "doc_id int, text string"))
    assert [(r["prefix"], r["n"]) for r in A.clause_prefixes(s, 3).collect()] == [("走过来", 4)] and A.clause_pairs(s).first()["n"] == 3
    assert {r["idx"]: (r["even"], r["doubled"]) for r in A.balanced(s).collect()} == {1: (True, []), 2: (True, ["高高兴兴", "来来往往", "明明白白"])}


def test_labels_flows_and_scenes(spark):
    rules = {"calm": ("静", "安"), "tense": ("急", "怒")}
    assert value(spark, A.best_label(F.lit("静静急"), rules)) == "calm" and value(spark, A.best_label(F.lit("x"), rules)) == "unclear" and value(spark, A.first_label(F.lit("ab"), [("b", "b"), ("a", "a")], "z")) == "b"
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["静", "静", "急", "静", "急", "急", "急"], 1)], "doc_id int, idx int, text string")
    r = A.flow(rows, A.best_label(F.col("text"), rules)).first()
    assert (r["counts"], r["switches"], r["longest"]) == ({"calm": 3, "tense": 4}, 3, 3)
    assert [(r["scene"], r["role"], r["first"], r["last"]) for r in A.scenes(rows, A.best_label(F.col("text"), rules), 2).orderBy("scene").collect()] == [(1, "calm", 1, 2), (2, "tense", 3, 3), (3, "calm", 4, 4), (4, "tense", 5, 6), (5, "tense", 7, 7)]
    assert [(r["first"], r["length"], r["hits"]) for r in A.battles(rows, ("急",)).collect()] == [(5, 3, 3)]
    v = A.viewpoints(spark.createDataFrame([(1, 1, "甲"), (1, 2, "甲乙"), (1, 3, "乙"), (1, 4, "甲")], "doc_id int, idx int, text string"), {"a": ("甲",), "b": ("乙",)}).first()
    assert (v["switches"], v["overlaps"]) == (2, 1)
    w = A.term_windows(rows, [("m", "急"), ("m", "静")], 3, most=1).first()
    assert (w["first"], w["last"], w["score"]) == (5, 7, 15)
    d = spark.createDataFrame([(1, i, "“x”") for i in range(1, 6)], "doc_id int, idx int, text string")
    assert [r["first"] for r in A.axis_gaps(d, ("y",)).orderBy("first").collect()] == [1, 2] and A.axis_gaps(d, ("x",)).count() == 0
    assert value(spark, A.quote_ratio(F.lit("“ab”cd"))) == pytest.approx(4 / 6)


def test_scores_plans_and_cards(spark, docs):
    assert value(spark, A.axis_score(4.0, [F.lit(1.5)], [F.lit(0.5)])) == 3.0 and value(spark, A.axis_score(4.0, [F.lit(9.0)], [])) == 1.0
    assert [value(spark, A.gate(*map(F.lit, g))) for g in ((4, 0, 5.0, 0), (2, 0, 5.0, 0), (0, 0, 3.0, 0), (0, 0, 4.0, 0))] == ["FAIL", "WATCH", "WATCH", "PASS"]
    sections = spark.createDataFrame([("p", "Goal"), ("p", "Events")], "path string, section string")
    assert [r["heading"] for r in A.missing_headings(sections, [("Goal",), ("Events", "Beats"), ("Loads",)]).collect()] == ["Loads"]
    events = spark.createDataFrame([("p", "fight"), ("p", "fight"), ("p", "talk"), ("q", "walk")], "path string, term string")
    assert [(r["path"], r["term"]) for r in A.monotony(events, "path", "term").collect()] == [("p", "fight")]
    cards = spark.createDataFrame([("a", "person", {"id": "X-1", "role": "-", "category": "items"}), ("b", "odd", {})], "path string, category string, fields map<string,string>")
    got = {(r["path"], r["warning"], r["field"]) for r in A.card_warnings(cards, {"person": ("P-", ("id", "role", "age"))}).collect()}
    assert got == {("a", "missing_field", "age"), ("a", "empty_field", "role"), ("a", "category_mismatch", "category"), ("a", "bad_id_prefix", "id"), ("b", "unknown_category", "odd")}
    r = A.rewritten(docs, spark.createDataFrame([(1, "好。", "嗯。"), (1, "她来了！", "她到了！")], "doc_id int, sentence string, rewrite string")).where("doc_id = 1").first()
    assert "她到了！嗯。" in r["text"]
    bank = spark.createDataFrame([("a", "x", True), ("b", " ", True), ("c", "y", False), ("d", "z", True)], "name string, pattern string, enabled boolean")
    assert [r["name"] for r in A.templates(bank, spark.createDataFrame([("d",)], "name string")).collect()] == ["a"]
