from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewell.operators import knowledge as K
from tidewell.operators import recall as R

FACTS = "id string, ws string, sess string, task string, kind string, text string, source_refs array<struct<session_id:string,event_id:string>>, trust_state string, valid_to long, created_at long, superseded_by string"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("f1", "w", "s1", "", "semantic", "the red fox", 10), ("f2", "w", "s1", "", "semantic", "the red red dog", 20), ("f3", "w", "s2", "", "episodic", "a blue fox", 30), ("f4", "v", "s1", "", "semantic", "the red fox", 40), ("f5", "w", "s1", "", "semantic", "red", 50)]
    return spark.createDataFrame([(*r[:6], [(r[2], "e")], "Trusted", None, r[6], None) for r in rows], FACTS)


def test_bm25_has_all_tokens_and_falls(facts):
    rows = R.bm25(facts.where("ws = 'w'"), "Red THE", 10).collect()
    assert [r["id"] for r in rows] == ["f2", "f1"] and rows[0]["rank"] == 1
    n, avg = 4, (3 + 4 + 3 + 1) / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda df, tf, size: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))
    assert math.isclose(rows[0]["score"], part(3, 2, 4) + part(2, 1, 4), rel_tol=1e-9)
    assert R.bm25(facts, "!?", 10).collect() == [] and R.bm25(facts, "red absent", 10).collect() == []


def test_vector_arm_is_scoped(spark):
    v = spark.createDataFrame([("a", "w", "s", "", [1.0, 0.0]), ("b", "w", "s", "", [0.0, 1.0]), ("c", "x", "s", "", [1.0, 0.0]), ("d", "w", "t", "", [1.0, 0.1])], "id string, ws string, sess string, task string, vector array<double>")
    assert [r["id"] for r in R.vector_arm(v, [1.0, 0.0], 5, "w").collect()] == ["a", "d", "b"]
    assert [r["id"] for r in R.vector_arm(v, [1.0, 0.0], 5, "w", "t").collect()] == ["d"] and R.vector_arm(v, [1.0, 0.0], 0, "w").collect() == []
    with pytest.raises(Exception, match="dimension"):
        R.vector_arm(v, [1.0], 5, "w").collect()


def test_temporal_centre():
    day = R.DAY_MS
    assert R.temporal_centre("on 1970-01-03 we met", 0) == 2 * day and R.temporal_centre("1970年1月2日", 0) == day
    assert R.temporal_centre("what was yesterday, not 1970/01/09", 5 * day + 7) == 4 * day and R.temporal_centre("昨天", 5 * day) == 4 * day
    assert R.temporal_centre("number 11970-01-03 and 1970-13-40", 0) is None and R.temporal_centre("nothing", 0) is None


def test_whole_recall(spark, facts):
    v = spark.createDataFrame([("f3", "w", "s2", "", [1.0, 0.0]), ("f1", "w", "s1", "", [0.9, 0.1])], "id string, ws string, sess string, task string, vector array<double>")
    e = spark.createDataFrame([("w", "s1", "f1", "f5", "Corrects", 1.0), ("w", "s1", "f5", "f2", "Related", 1.0)], "ws string, sess string, src string, dst string, rel string, weight double")
    out = R.recall(facts, v, e, "fox", [1.0, 0.0], R.Options(), "w")
    rows = {r["id"]: r for r in out.hits.collect()}
    assert out.degraded == {} and set(rows) == {"f1", "f2", "f3", "f5"} and rows["f1"]["via"] == "vector+lexical+graph" and rows["f5"]["via"] == "graph"
    assert "f4" not in rows and rows["f1"]["rank"] == 1 and rows["f1"]["summary"] == "the red fox"
    assert {r["id"] for r in R.recall(facts, None, None, "fox", None, R.Options(since=20), "w").hits.collect()} == {"f3"}
    broken = R.recall(facts, v.drop("vector"), e, "fox", [1.0], R.Options(), "w")
    assert "vector" in broken.degraded and {r["id"] for r in broken.hits.collect()} >= {"f1", "f3"}
    dated = R.recall(facts.withColumn("created_at", F.col("created_at") * R.DAY_MS), v, None, "fox 1970-01-11", [1.0, 0.0], R.Options(arms=("vector",)), "w")
    assert [r["id"] for r in dated.hits.orderBy("rank").collect()] == ["f1", "f3"]
    health = {r["arm"]: r for r in R.supply(out.hits, 4).collect()}
    assert health["graph"]["exclusive"] == 2 and not health["vector"]["saturated"]
    assert R.judged(out.hits, F.lit(0.01), 0.05).count() == 0 and R.judged(out.hits, F.when(F.col("id") == "f5", 0.9).otherwise(0.1), 0.05).orderBy("rank").first()["id"] == "f5"


def test_edges_and_readers(spark, facts):
    e = spark.createDataFrame([("w", "s", "a", "b", "DependsOn", 1.0), ("w", "s", "b", "c", "Corrects", 2.0), ("w", "s", "c", "d", "Related", 3.0), ("w", "s", "a", "b", "DependsOn", 1.0)], "ws string, sess string, src string, dst string, rel string, weight double")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert sorted((r["src"], r["dst"]) for r in R.edges_of(e, seeds, 2).collect()) == [("a", "b"), ("b", "c")]
    assert [(r["src"], r["rel"]) for r in R.derivations(e.distinct(), "w").collect()] == [("a", "DependsOn"), ("b", "Corrects")] and R.by_kind(e, "Related", "w").count() == 1
    assert [r["other"] for r in R.relations_of(e.distinct(), "c", 5).collect()] == ["d", "b"]
    assert [r["id"] for r in R.of_kind(facts, "episodic", "w").collect()] == ["f3"]
    assert [r["id"] for r in R.timeline(facts.withColumn("story", F.when(F.col("id") != "f5", 50 - F.col("created_at"))), "story").collect()] == ["f5", "f4", "f3", "f2", "f1"]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n, "t", f"about {n}", f"c{i}<SEP>c0", f"p{i % 2}", i) for i, n in enumerate("ABCD")], "entity_name string, entity_type string, description string, source_id string, file_path string, created_at long")
    edges = spark.createDataFrame([("A", "B", "d1", "k", 1.0, "c1", "p0", 5), ("C", "A", "d2", "k", 1.0, "c2", "p0", 6), ("C", "D", "d3", "k", 1.0, "c3", "p1", 7)], "src string, tgt string, description string, keywords string, weight double, source_id string, file_path string, created_at long")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}", 10, f"p{i % 2}", "v" if i < 2 else None, i) for i in range(5)], "chunk_id string, content string, tokens int, file_path string, conversation_id string, timestamp long")
    return nodes, edges, chunks


def test_arms_of_the_graph(spark, graph):
    nodes, edges, chunks = graph
    hits = spark.createDataFrame([("C", 1), ("gone", 2), ("A", 3)], "entity_name string, rank long")
    entities, near = K.entity_rows(hits, nodes, edges)
    assert {r["entity_name"]: (r["rank"], r["degree"]) for r in entities.collect()} == {"C": (1, 2), "A": (3, 2)}
    assert [(r["src"], r["tgt"]) for r in near.orderBy("rank").collect()] == [("A", "B"), ("C", "A"), ("C", "D")]
    pairs = spark.createDataFrame([("D", "C", 1), ("A", "B", 2)], "src string, tgt string, rank long")
    found, ends = K.relation_rows(pairs, edges, nodes)
    assert found.count() == 2 and [r["entity_name"] for r in ends.orderBy("rank").collect()] == ["C", "D", "A", "B"]
    assert [r["chunk_id"] for r in K.chunks_of(entities, chunks).orderBy("rank").collect()] == ["c0", "c2"]
    order = spark.createDataFrame([("c3", 1), ("c9", 2), ("c1", 3)], "chunk_id string, rank long")
    assert [r["chunk_id"] for r in K.chunk_hits(order, chunks, K.Param()).orderBy("rank").collect()] == ["c3", "c1"]
    assert [r["chunk_id"] for r in K.chunk_hits(order, chunks, K.Param(conversation_id="v")).collect()] == ["c1"]
    first, second = order.where("rank <> 2"), spark.createDataFrame([("c1", 1), ("c4", 2)], "chunk_id string, rank long")
    assert [r["chunk_id"] for r in K.merged(first, second, ["chunk_id"]).orderBy("rank").collect()] == ["c3", "c1", "c4"]


def test_budget_rerank_and_context(spark, graph):
    nodes, edges, chunks = graph
    ranked = chunks.withColumn("rank", F.col("timestamp") + 1)
    assert K.within(ranked, F.col("tokens"), 22).count() == 2 and K.within(ranked, F.col("tokens"), 0).count() == 0
    cut = K.fused(ranked.union(ranked), K.Param(chunk_top_k=3, min_rerank_score=0.2), F.col("timestamp") / 10.0)
    assert [r["chunk_id"] for r in cut.orderBy("rank").collect()] == ["c4", "c3", "c2"]
    assert K.in_time(nodes, K.Param(since=2000)).count() == 2 and K.in_time(nodes, K.Param()).count() == 4
    hits = spark.createDataFrame([("C", 1)], "entity_name string, rank long")
    pairs = spark.createDataFrame([("A", "B", 1)], "src string, tgt string, rank long")
    order = spark.createDataFrame([("c4", 1)], "chunk_id string, rank long")
    sizes = {}
    for mode in K.MODES:
        out = K.answer_context(K.Param(mode=mode), nodes, edges, chunks, hits, pairs, order)
        sizes[mode] = tuple(out[k].count() for k in ("entities", "relations", "chunks"))
        text = out["context"].first()["context"]
        assert text.startswith("Entities:\n") and "References:\n" in text
    assert sizes == {"local": (1, 2, 3), "global": (2, 1, 2), "hybrid": (3, 3, 4), "mix": (3, 3, 5), "naive": (0, 0, 1)}
    assert '"id":"DC1","content":"text 4"' in K.answer_context(K.Param(mode="naive"), nodes, edges, chunks, hits, pairs, order)["context"].first()["context"]
    with pytest.raises(ValueError):
        K.answer_context(K.Param(mode="odd"), nodes, edges, chunks, hits, pairs, order)
    assert K.keywords_for("short", [], []) == ("", "short") and K.keywords_for("x" * 50, [], []) is None and K.keywords_for("q", ["a", "b"], []) == ("a, b", "")
