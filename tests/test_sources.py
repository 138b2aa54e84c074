from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files as S
from tidewell.sources import stores as W


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_documents_and_trees(spark, tmp_path, monkeypatch):
    import io

    (tmp_path / "drafts/arc1/story2").mkdir(parents=True)
    for name, text in (("drafts/arc1/story2/chapter10.md", "# Ten\nA\n"), ("drafts/arc1/story2/chapter2.md", "# Two\nB\n\nC"), ("drafts/notes.md", "x"), ("drafts/stats.md", "made"), ("drafts/a.txt", "no")):
        (tmp_path / name).write_text(text)
    docs = S.documents(spark, [f"{tmp_path}/drafts/notes.md", f"{tmp_path}/drafts/a.txt"]).collect()
    assert sorted(r["text"] for r in docs) == ["no", "x"] and all(r["doc_id"].startswith("doc-") for r in docs)
    monkeypatch.setattr("sys.stdin", io.StringIO("typed"))
    assert [r["text"] for r in S.documents(spark, ["-"]).collect()] == ["typed"]
    rows = S.chapters(spark, f"{tmp_path}/drafts").orderBy("number", "path").collect()
    assert [r["number"] for r in rows] == [2, 10, 9999] and S.tree(spark, f"{tmp_path}/drafts", generated=True).count() == 4
    kinds = {r["path"].rsplit("/", 1)[1]: r["c"] for r in S.tree(spark, f"{tmp_path}").select("path", S.classified(F.col("path"), f"{tmp_path}").alias("c")).collect()}
    assert tuple(kinds["chapter10.md"]) == ("drafts", "arc1", "story2", "chapter10") and tuple(kinds["notes.md"]) == ("drafts", None, None, None)


def test_markdown(spark):
    docs = spark.createDataFrame([("d/person/a.md", "# Ann\n- aliases: A、Annie / A\n- role：hero\n- role: villain\n\n## Facts\ntext\n- one\n* two\n## Empty\n")], "path string, text string")
    assert [(r["line"], r["level"], r["title"]) for r in S.headings(docs).orderBy("line").collect()] == [(1, 1, "Ann"), (6, 2, "Facts"), (10, 2, "Empty")]
    sections = {r["section"]: r["body"] for r in S.sections(docs).collect()}
    assert sections["Facts"].startswith("text") and sections["Empty"] == "" and value(spark, S.bullets(F.lit("a\n- one\n* two\n-x"))) == ["one", "two"]
    card = S.cards(docs).first()
    assert (card["category"], card["title"], card["aliases"], card["fields"]["role"]) == ("person", "Ann", ["A", "Annie"], "villain")
    assert [tuple(p) for p in value(spark, S.passages(F.lit("a\nb\n\n \nc\n")))] == [(1, 2, "a\nb"), (5, 5, "c")] and value(spark, S.passages(F.lit(""))) == []


def test_feedback_and_reports(spark, tmp_path):
    path = f"{tmp_path}/feedback"
    rows = spark.createDataFrame([("k", "c", "s", 3, None)], "conflict_key string, category string, story string, decision int, note string")
    S.append_feedback(rows, path)
    S.append_feedback(rows.withColumn("story", F.lit("t")), path)
    (tmp_path / "feedback/odd.txt").write_text("not json\n")
    got = S.feedback(spark, path).collect()
    assert sorted((r["story"], r["decision"], r["note"]) for r in got) == [("s", "3", None), ("t", "3", None)]
    S.report(rows, f"{tmp_path}/md", "Title")
    assert "# Title" in "".join(p.read_text() for p in (tmp_path / "md").glob("part*"))
    S.report(rows, f"{tmp_path}/json")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "json").glob("part*")))["decision"] == 3


def test_rules_settings_and_catalogs(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("# rules\nregex_bank:\n  - name: a\n    pattern: 'x+'\n    max_per_10k: 2.5\n  - name: b\n    pattern: y\nlimit: 3\nflags: [1, 2]\n")
    rules = S.rules(spark, f"{tmp_path}/r.yaml")
    assert [(r["section"], r["name"], r["pattern"], r["max_per_10k"]) for r in rules.orderBy("name").collect()] == [("regex_bank", "a", "x+", 2.5), ("regex_bank", "b", "y", 0.0)]
    S.write_rules(rules.where("name = 'a'").withColumn("pattern", F.lit("z")), rules, f"{tmp_path}/out")
    assert [r["pattern"] for r in S.rules(spark, f"{tmp_path}/out").orderBy("name").collect()] == ["z", "y"]
    with pytest.raises(ValueError):
        S.plain_yaml("a: |\n  x")
    (tmp_path / "c.toml").write_text("[query]\ntop_k = 7\n")
    assert S.settings(spark, f"{tmp_path}/c.toml", {"query": {"top_k": 40, "mode": "mix"}, "x": 1}) == {"query": {"top_k": 7, "mode": "mix"}, "x": 1}
    (tmp_path / "cat.json").write_text('{"template_candidates": [], "term_candidates": [{"name": "a"}]}')
    assert S.catalog(spark, f"{tmp_path}/cat.json")["term_candidates"][0]["name"] == "a"
    with pytest.raises(ValueError):
        S.catalog(spark, f"{tmp_path}/cat.json", ["absent"])


def test_sessions_and_slices(spark, tmp_path):
    line = json.dumps({"session_id": "s", "turns": [{"turn_id": "1", "role": "user", "content": "x", "timestamp": 5}]})
    assert S.sessions(spark.createDataFrame([(line,)], "value string")).first()["turns"][0]["timestamp"] == 5
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.sessions(spark.createDataFrame([("[",)], "value string")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"case_id": "c", "conversation_id": "v", "turns": [{"turn_id": "t1", "speaker": "user", "content": "q", "timestamp": 1}, {"turn_id": "t2", "speaker": "agent", "content": "a", "timestamp": 2}], "query": {"gold_turn_id": "t2"}}))
    assert [(r["role"], r["evidence"]) for r in S.slices(spark, f"{tmp_path}/m.json", "turns").orderBy("timestamp").collect()] == [("user", False), ("assistant", True)]
    (tmp_path / "l.json").write_text(json.dumps({"sessions": [{"session_id": "s1", "date": "2023/05/30 (Tue) 21:40", "turns": [{"role": "user", "content": "x", "evidence": True}, {"role": "assistant", "content": "y"}]}], "query": {"question_id": "q"}}))
    rows = S.slices(spark, f"{tmp_path}/l.json", "sessions").orderBy("timestamp").collect()
    assert [(r["turn_id"], r["timestamp"], r["evidence"]) for r in rows] == [("s1-0", 1685482800000, True), ("s1-1", 1685482801000, False)]
    assert value(spark, S.session_time(F.lit("2023-05-30"))) is None


def test_workspace(spark, tmp_path):
    w = W.Workspace(spark, f"{tmp_path}/w")
    kv = lambda *rows: spark.createDataFrame(list(rows), "namespace string, key string, value string, n int")
    assert w.keys("a").count() == 0 and w.get("a", "x") is None
    w.upsert("kv", kv(("a", "x", "1", 0), ("a", "x", "2", 1), ("b", "x", "9", 0)), order="n")
    w.upsert("kv", kv(("a", "y", "3", 0)))
    assert w.get("a", "x") == "2" and w.get("b", "x") == "9"
    wanted = spark.createDataFrame([(0, "y"), (1, "z"), (2, "x")], "pos int, key string")
    assert [r["value"] for r in w.get_many("a", wanted).orderBy("pos").collect()] == ["3", None, "2"]
    assert [r["key"] for r in w.missing("a", wanted.select("key")).collect()] == ["z"]
    w.remove("kv", spark.createDataFrame([("a", "x")], "namespace string, key string"))
    w.drop("b")
    assert [tuple(r)[:2] for r in w.read("kv").collect()] == [("a", "y")]
    W.record_pending(w, spark.createDataFrame([("vec", "n1", "p"), ("vec", "n2", "p"), ("doc", "n3", "p")], "target string, name string, payload string"))
    seen = []
    assert W.replay(w, "vec", lambda rows: seen.extend(r["name"] for r in rows.collect())) == 2 and sorted(seen) == ["n1", "n2"] and W.replay(w, "vec", seen.append) == 0


def test_graph_tables(spark):
    nodes = spark.createDataFrame([("a", {"x": "1", "y": "2"}, 0), ("b", {}, 1)], "id string, data map<string,string>, seq long")
    new = spark.createDataFrame([("a", {"x": "9"}, 5), ("c", {"z": "1"}, 6)], "id string, data map<string,string>, seq long")
    got = {r["id"]: (r["data"], r["seq"]) for r in W.merged_attributes(nodes, new, ["id"]).collect()}
    assert got == {"a": ({"x": "9", "y": "2"}, 0), "b": ({}, 1), "c": ({"z": "1"}, 6)}
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 1), ("c", "a", 2), ("b", "c", 3), ("a", "a", 4)], "src string, tgt string, seq long")
    assert [r["other"] for r in W.incident(edges, "a").collect()] == ["b", "a", "b", "c"]
    n, e = W.without_nodes(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert n.count() == 1 and [(r["src"], r["tgt"]) for r in e.collect()] == [("b", "c")]
    assert [r["present"] for r in W.has(nodes, spark.createDataFrame([("a",), ("q",)], "id string"), ["id"]).orderBy("id").collect()] == [True, False]
