from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import communities as C
from tidewell.operators import evaluation as E
from tidewell.operators import retrieval as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_quality_and_passing(spark):
    cases = spark.createDataFrame([("c", "tuning", "q1", ["red", "fox"], ["bad"], 2), ("c", "tuning", "q2", ["x"], [], 2), ("d", "holdout", "q1", [], ["bad"], 2)], "case_id string, set string, query_id string, expected array<string>, forbidden array<string>, top_k int")
    hits = spark.createDataFrame([("c", "q1", 1, "a red one"), ("c", "q1", 2, "dog"), ("c", "q1", 3, "fox"), ("d", "q1", 1, "bad")], "case_id string, query_id string, rank int, summary string")
    q = {(r["case_id"], r["query_id"]): r for r in E.quality(cases, hits).collect()}
    assert (q["c", "q1"]["recall"], q["c", "q1"]["missed"], q["c", "q1"]["top_hit"]) == (0.5, True, True) and q["c", "q2"]["recall"] == 0.0 and q["d", "q1"]["wrong"]
    results = E.case_results(E.quality(cases, hits))
    conditions = spark.createDataFrame([("c", 0.2, True, False), ("d", 0.0, True, False)], "case_id string, min_recall double, forbid_wrong_evidence boolean, expect_top_hit boolean")
    assert {r["case_id"]: r["passed"] for r in E.passed(results, conditions).collect()} == {"c": True, "d": False}
    assert E.pooled_recall(E.quality(cases, hits)).first()[0] == 0.5
    s = spark.createDataFrame([("c", m) for m in range(1, 21)], "case_id string, micros int")
    r = E.latency(s, ["case_id"]).first()
    assert (r["p50"], r["p95"], r["samples"]) == (11, 20, 20)


def test_judges(spark):
    rows = spark.createDataFrame([(0.0, False), (0.9, True), (0.95, False), (0.5, True)], "c double, ok boolean")
    want = sum(abs(sum(c for c, _ in b) / len(b) - sum(o for _, o in b) / len(b)) * len(b) / 4 for b in ([(0.0, 0)], [(0.9, 1)], [(0.95, 0)], [(0.5, 1)]))
    assert E.calibration_error(rows, "c", "ok").first()["ece"] == pytest.approx(want)
    p = lambda **k: F.create_map(*[x for n, v in k.items() for x in (F.lit(n), F.lit(v))])
    assert value(spark, E.selected(p(a=0.4, b=0.4, c=0.2))) == "a" and value(spark, E.margin(p(a=0.9, b=0.1))) == pytest.approx(0.8)
    assert value(spark, E.decision(p(a=0.9, b=0.1))) == "a" and value(spark, E.decision(p(a=0.8, b=0.2))) is None
    assert value(spark, E.valid_choice(p(a=0.9, b=0.1), ["b", "a"])) and not value(spark, E.valid_choice(p(a=0.9, b=0.2), ["a", "b"])) and not value(spark, E.valid_choice(p(a=1.0), ["a", "b"]))
    assert [value(spark, E.presence(F.lit(x))) for x in (0.7, 0.5, 0.1)] == ["found", "unsure", "absent"]
    answers = spark.createDataFrame([("t", "choice", "q1", 1, "a", "a", 0.9), ("t", "choice", "q1", 2, "b", "a", 0.9), ("t", "noul", "q2", 1, None, "a", None), ("t", "noul", "q2", 2, None, "a", None)], "tier string, op string, question_id string, repeat int, choice string, gold string, confidence double")
    r = E.tier_metrics(answers).first()
    assert (r["accuracy"], r["abstain_rate"], r["flip_rate"], r["ece"]) == (0.5, 0.5, 0.5, pytest.approx(0.4)) and E.by_operation(answers).first()["n"] == 2
    tiers = spark.createDataFrame([("a", 1, 0.5, 40, ["x"]), ("b", 2, 0.8, 100, ["x", "y"]), ("c", 3, 0.7, 90, ["y"])], "tier string, place int, accuracy double, footprint int, components array<string>")
    got = {r["tier"]: (r["gain"], r["added"], r["removed"]) for r in E.curve(tiers).collect()}
    assert got["b"][0] == pytest.approx(0.3) and got["b"][1:] == (["y"], []) and got["c"][1:] == ([], ["x"])
    for label in ("a", "b:0.5", ""):
        assert value(spark, E.draw_column(F.lit(label))) == pytest.approx(E.draw(label), abs=1e-12)
    q = spark.range(200).select(F.col("id").cast("string").alias("question_id"), F.lit("g").alias("gold"), F.lit("w").alias("wrong"))
    assert 0.6 < E.mock_answers(q, 0.7).agg(F.avg((F.col("choice") == "g").cast("int"))).first()[0] < 0.8


def test_attribution(spark):
    base = {"captured": True, "delivered": False, "current": True, "visible": True, "stale": False, "position": 3, "judged": False, "exists": True, "candidates": 5, "top_k": 10}
    changes = [{"captured": False}, {"delivered": True}, {"current": False}, {"visible": False}, {"stale": True}, {"position": None, "stale": True}, {"judged": True, "exists": False, "candidates": 0}, {"position": 10}, {"judged": True}, {}]
    schema = "i int, captured boolean, delivered boolean, current boolean, visible boolean, stale boolean, position int, judged boolean, exists boolean, candidates int, top_k int"
    rows = spark.createDataFrame([(i, *(base | c).values()) for i, c in enumerate(changes)], schema)
    assert tuple(r["stage"] for r in E.attribution(rows).orderBy("i").collect()) == E.STAGES


def test_search():
    def measure(knobs, which):
        hops = knobs["recall.graph_hops"]
        recall = {"tuning": 1.0 if hops >= 3 else 0.5, "holdout": 1.0}[which]
        return {"c": (recall, 1.0 if knobs["recall.near_zero"] > 0.05 else 0.0, recall == 1.0)}

    s = E.Search(measure, 0.2)
    assert s.propose() == ("recall.graph_hops", 3) and s.run() == [("recall.graph_hops", 3)] and s.propose() is None
    assert ("recall.near_zero", 0.1) in s.refuted and s.evaluate(("recall.near_zero", 2.0))[0] == "out_of_bounds"
    with pytest.raises(ValueError):
        s.commit(("recall.graph_hops", 4), "noise_floor")
    assert json.loads(s.scoreboard())["knobs"]["recall.graph_hops"] == 3 and E.knobs_for("JudgeCleared") == ["recall.near_zero"]
    assert E.Search(lambda k, w: {}, 0.1).evaluate(("recall.graph_hops", 3))[0] == "regression"


def test_cases(spark):
    d = E.distractors(spark, 3)
    assert d.count() == 12 and d.select("conversation_id").distinct().count() == 3 and set(" ".join(r["content"] for r in d.collect()).split()) <= set(E.VOCABULARY)
    nodes, edges = E.chain(spark, 5)
    reached = R.hops(edges, nodes.where("id = 'n0'"), 3)
    assert {r["id"]: r["hop"] for r in reached.collect()} == {"n0": 0, "n1": 1, "n2": 2, "n3": 3}
    assert value(spark, E.probe_terms(F.lit("What did the Fox, fox eat in 2020?"), F.lit("the fox will eat"))) == ["fox", "eat"]
    row = {"row_id": "r", "questions": [{"question_id": "q", "gold": {"probabilities": {"a": 0.6, "b": 0.4}}}]}
    assert E.frozen([row])[0] == E.frozen([dict(reversed(row.items()))])[0]
    for bad in ([row, row], [{"row_id": "r", "questions": row["questions"] * 2}], [{"row_id": "r", "questions": [{"question_id": "q", "gold": {"probabilities": {"a": 0.6}}}]}]):
        with pytest.raises(ValueError):
            E.frozen(bad)


@pytest.fixture(scope="module")
def cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0", 0.5), ("c0", "d0", 0.5), ("b1", "c1", 0.1)]
    return spark.createDataFrame(pairs, "src string, tgt string, weight double")


def modularity(pairs, label):
    m = sum(w for *_, w in pairs)
    k = {}
    for a, b, w in pairs:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(w for a, b, w in pairs if label[a] == label[b]) / m
    return inside - sum((sum(k[n] for n in k if label[n] == c) / (2 * m)) ** 2 for c in set(label.values()))


def test_communities(spark, cliques):
    pairs = [tuple(r) for r in cliques.collect()]
    label = {r["node"]: r["label"] for r in C.partition(cliques).collect()}
    sizes = {}
    for x in label.values():
        sizes[x] = sizes.get(x, 0) + 1
    assert set(label) == {n for a, b, _ in pairs for n in (a, b)} and max(sizes.values()) <= C.MOST and modularity(pairs, label) > 0.55
    h = C.hierarchy(cliques).cache()
    levels = sorted(r[0] for r in h.select("level").distinct().collect())
    assert levels[0] == 0 and h.groupBy("level").count().where("count <> 20").count() == 0
    numbers = [r[0] for r in h.select("level", "cluster").distinct().orderBy("cluster").collect()]
    assert numbers == sorted(numbers)
    nodes = spark.createDataFrame([(n, f"c{n[0]}") for n in label], "node string, source_id string")
    rows = C.schema(h, nodes, cliques.withColumn("source_id", F.lit("e1"))).collect()
    assert max(r["occurrence"] for r in rows) <= 1.0 and all(r["nodes"] == sorted(r["nodes"]) for r in rows)
    fine = max(levels)
    for r in rows:
        below = [set(x["nodes"]) for x in rows if x["level"] == r["level"] + 1]
        assert len(r["children"]) == sum(b <= set(r["nodes"]) for b in below) and (r["level"] < fine or not r["children"])
    assert [d.first()["level"] for d in C.in_report_order(h.select("level", "cluster").distinct())] == sorted(levels, reverse=True)
    assert C.partition(cliques.limit(0)).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([(1, "node", "n1", 5, 0), (1, "node", "n2", 9, 1), (1, "edge", "e1", 3, 0), (1, "edge", "e2", 1, 1)], "cluster int, kind string, line string, degree int, idx int")
    kept = C.packed(rows, 8, F.lit(1))
    assert C.description(kept).first()["text"] == "n2\nn1\ne1\ne2" and C.description(C.packed(rows, 4, F.lit(1))).first()["text"] == "n2\ne1"
    assert C.uncovered(rows, rows.where("line = 'n1'"), ["line"]).count() == 3
    report = json.dumps({"title": "T", "summary": "S", "rating": "7.5", "findings": ["plain", {"summary": "A", "explanation": "B"}]})
    assert C.report_markdown(report) == "# T\n\nS\n\n## plain\n\n\n\n## A\n\nB" and C.rating(report) == 7.5 and C.report_markdown("x") == "" and C.rating("[]") == 0.0
