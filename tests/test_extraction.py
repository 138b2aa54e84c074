from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import records as X
from tidewell.functions import text as T
from tidewell.functions import tokens
from tidewell.operators import extraction as E


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_unescape(spark):
    for given, want in (("a &amp;lt; b", "a &lt; b"), ("&AMP;&#65;&#x42;&#X43;&nbsp;|", "&ABC |"), ("&copy; &#55296; &; & ;", "&copy; &#55296; &; & ;"), ("&#128512;&quot;&apos;&#39;", "😀\"''"), ("plain", "plain"), ("", ""), ("&#9999999999999999999999999999;", "&#9999999999999999999999999999;")):
        assert value(spark, T.html_unescape(F.lit(given))) == want, given


def test_normalized(spark):
    cases = {(' "Ａｂ１" ', True): "Ab1", ("中 国 AI 模型", True): "中国AI模型", ("《红楼梦》", True): "红楼梦", ("'it's'", True): "'it's'", ("12", True): "", ("1.23", True): "", ("123", True): "123", ("a<br/>b", False): "ab", ("“x” y", True): "x y", ("“x” y", False): "“x” y", ("（a）—b", False): "(a)-b"}
    for (given, inner), want in cases.items():
        assert value(spark, X.normalized(F.lit(given), inner)) == want, given


def test_entity_type(spark):
    for given, want in ((" Person Name", "personname"), (",, City ,x", "city"), ("a/b", None), ("", None), ("Prototype", None), (",,", None), ("Org,Other", "org")):
        assert value(spark, X.entity_type(F.lit(given))) == want, given


def chunks(spark, *raws):
    return spark.createDataFrame([(f"c{i}", r, f"f{i % 2}", 100 + i, i) for i, r in enumerate(raws)], "chunk_id string, raw string, file_path string, timestamp long, seq long")


D = X.TUPLE


def test_parse(spark):
    raw = "\n".join([
        f"entity{D}Alice{D}Person{D}A girl", f"relation{D}Bob{D}Alice{D}knows，likes{D}they met", f"entity{D}Bob{D}Alice{D}knows{D}again",
        f"entity{D}Carl{D}Person{D}x{D}entity{D}Dora{D}Person{D}y{D}relationship{D}Carl{D}Dora{D}k{D}z", f"Eve{D}Person{D}lost its mark", f"entity{D}Bad{D}a/b{D}no", f"relation{D}Al{D}Al{D}k{D}d", f"entity{D}{D}Person{D}d",
    ]) + "<|complete|>"
    entities, relations = E.parse(chunks(spark, raw))
    assert [r["entity_name"] for r in entities.orderBy("seq", "pos").collect()] == ["Alice", "Carl", "Dora", "Eve"]
    assert [(r["src"], r["tgt"], r["keywords"], r["description"]) for r in relations.orderBy("pos").collect()] == [("Alice", "Bob", "knows,likes", "they met"), ("Alice", "Bob", "knows", "again"), ("Carl", "Dora", "k", "z")]


def test_merges(spark):
    entities, relations = E.parse(chunks(spark, f"entity{D}A{D}city{D}one\nentity{D}A{D}town{D}longer text\nrelation{D}A{D}B{D}x, y{D}d", f"entity{D}A{D}town{D}one\nrelation{D}B{D}A{D}y,a{D}e", f"entity{D}N{D}city{D}"))
    stored = spark.createDataFrame([("A", "city", "old", f"c9{X.SEP}c0", "f9", 7)], "entity_name string, entity_type string, description string, source_id string, file_path string, created_at long")
    got = {r["entity_name"]: r for r in E.merge_entities(entities, stored).collect()}
    a = got["A"]
    assert a["entity_type"] == "city" and a["description"] == "old<SEP>longer text<SEP>one" and a["source_id"] == "c0<SEP>c1<SEP>c9" and a["file_path"] == "f9<SEP>f0<SEP>f1" and a["created_at"] == 100
    was = spark.createDataFrame([("A", "B", 5.0, "c0", "was", "z")], "src string, tgt string, weight double, source_id string, description string, keywords string")
    r = E.merge_relations(relations, was).first()
    assert (r["weight"], r["keywords"], r["description"], r["source_id"], r["order"]) == (6.0, "a, x, y, z", "was<SEP>d<SEP>e", "c0<SEP>c1", 0)
    assert E.merge_relations(relations, was.limit(0)).first()["weight"] == 2.0
    rows = E.tracking(entities, spark.createDataFrame([("A", ["c7", "c0"])], "entity_name string, chunks array<string>"), ["entity_name"], 2)
    assert {r["entity_name"]: r["chunks"] for r in rows.collect()} == {"N": ["c2"]} if "N" in got else rows.count() == 0
    last = E.tracking(entities, spark.createDataFrame([("A", ["c7", "c0"])], "entity_name string, chunks array<string>"), ["entity_name"], 2, keep_first=False)
    assert {r["entity_name"]: r["chunks"] for r in last.collect()}["A"] == ["c0", "c1"]
    docs = spark.createDataFrame([("c0", "d0"), ("c1", "d0")], "chunk_id string, doc_id string")
    assert E.anchors(entities, relations, docs).first()["relations"] == ["A<SEP>B"]
    assert E.relation_vectors(E.merge_relations(relations, was)).first()["ids"][0].startswith("rel-")
    assert E.entity_vectors(E.merge_entities(entities, stored)).where("entity_name = 'A'").first()["content"].startswith("A\nold")


def test_records_are_parsed_once(spark):
    """A merge reads what the parser gives once, and moves it once; no field is normalised again by a filter."""
    entities, relations = E.parse(chunks(spark, f"entity{D}A{D}city{D}one", f"relation{D}A{D}B{D}x{D}d"))
    stored = spark.createDataFrame([], "entity_name string, entity_type string, description string, source_id string, file_path string, created_at long")
    was = spark.createDataFrame([], "src string, tgt string, weight double, source_id string, description string, keywords string")
    for merged in (E.merge_entities(entities, stored), E.merge_relations(relations, was)):
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate posexplode") == 1 and plan.count("RepartitionByExpression") == 1


def test_merges_of_odd_records(spark):
    """Late times, equal descriptions under several types, null fields; weights of stored and new sources."""
    rows = [("A", "x", "d1", 0, 1, "s1", "f1", 9), ("A", "y", "d1", 0, 0, "s0", "f0", 20), ("A", "x", "d2", 1, 0, "s1", None, 10), ("A", "y", None, 2, 0, "s2", "f0", 0), ("A", None, "", 3, 0, None, "f2", None), ("B", None, "b", 0, 0, "s", "f", 1)]
    records = spark.createDataFrame(rows, "entity_name string, entity_type string, description string, seq long, pos int, source_id string, file_path string, timestamp long")
    none = spark.createDataFrame([], "entity_name string, entity_type string, description string, source_id string, file_path string, created_at long")
    got = E.merge_entities(records, none).collect()
    assert [tuple(r) for r in got] == [("A", "y", "d2<SEP>d1", "s0<SEP>s1<SEP>s2", "f0<SEP>f1<SEP>f2", 20, 2)]
    assert E.merge_entities(records, spark.createDataFrame([("A", "x", None, None, None, None), ("Z", "z", "z", "z", "z", 1)], none.schema)).first()["entity_type"] == "x"
    known = spark.createDataFrame([("A", "B", 2.0, "s3<SEP>s1<SEP>s1", "", None), ("A", "C", 1.0, "", None, "k")], "src string, tgt string, weight double, source_id string, description string, keywords string")
    new = [("A", t, w, f"s{i % 5}" if i < 9 else None, "d", "k", i, 0, 1) for t in "BC" for i, w in enumerate([0.5, 8.0, 0.25, 8.0, 0.5, 1.0, 8.0, 2.0, 8.0, 4.0])]
    records = spark.createDataFrame(new, "src string, tgt string, weight double, source_id string, description string, keywords string, seq long, pos int, timestamp long")
    assert {r["tgt"]: (r["weight"], r["source_id"]) for r in E.merge_relations(records, known).collect()} == {"B": (10.25, "s0<SEP>s1<SEP>s2<SEP>s3<SEP>s4"), "C": (41.25, "s0<SEP>s1<SEP>s2<SEP>s3<SEP>s4")}


def test_plain_values_stay(spark):
    """The short way of normalisation and of markers gives what the long one does."""
    given = ["A b", "a.b/c", "Ab-", "a  b", "a\n", "a;b", "12", "1.2", "a12", "a\u2028", "a \u2028", "\u00a0a", "x &amp; y", "“a”", "日 a", "", " ", "a'日", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").repartition(2)
    got = [r["n"] for r in df.select("i", X.normalized(F.col("v"), True).alias("n")).orderBy("i").collect()]
    assert got == ["A b", "a.b/c", "Ab-", "a  b", "a", "a;b", "", "", "a12", "a\u2028", "a\u2028", "a", "x & y", "a", "日a", "", "", "a日", None]
    parts = [r["p"] for r in df.select("i", T.split_markers(F.col("v"), ("&", ";")).alias("p")).orderBy("i").collect()]
    assert parts[3:6] == [["a  b"], ["a"], ["a", "b"]] and parts[9:13] == [["a\u2028"], ["a\u2028"], ["\u00a0a"], ["x", "amp", "y"]] and parts[15:17] == [[], []] and parts[18] is None


def test_purge_and_cache(spark):
    entities, _ = E.parse(chunks(spark, f"entity{D}A{D}city{D}one\nentity{D}B{D}city{D}b", f"entity{D}A{D}town{D}two", f"entity{D}C{D}town{D}c"))
    stored = E.merge_entities(entities, spark.createDataFrame([], "entity_name string, entity_type string, description string, source_id string, file_path string, created_at long")).drop("n_fragments")
    track = spark.createDataFrame([("A", ["c0", "c1"])], "entity_name string, chunks array<string>")
    deleted = spark.createDataFrame([("c0",)], "chunk_id string")
    same, rebuilt, gone = E.purge(stored, track, entities, deleted)
    assert [r[0] for r in same.select("entity_name").collect()] == ["C"] and [r[0] for r in gone.collect()] == ["B"]
    r = rebuilt.first()
    assert (r["entity_name"], r["entity_type"], r["description"], r["source_id"]) == ("A", "town", "two", "c1")
    cache = spark.createDataFrame([("k0",), ("k1",), ("k2",)], "key string")
    refs = spark.createDataFrame([("c0", ["k0", "k1"]), ("c1", ["k1"])], "chunk_id string, cache_keys array<string>")
    assert sorted(r[0] for r in E.unreferenced(cache, refs, deleted).collect()) == ["k1", "k2"]
    assert E.dangling(stored.withColumn("source_id", F.lit("")), track).count() == 2
    assert value(spark, E.remaining_sources(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("a")))) == ["b", "c"]


def test_batches_and_summary(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 4, 6, 20, 1])], "k string, i int, t int")
    assert [r["batch"] for r in E.batches(df, "k", "i", "t", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert value(spark, E.needs_summary(F.array(*[F.lit("x")] * 8), F.lit(3))) and not value(spark, E.needs_summary(F.array(F.lit("x")), F.lit(1200)))


def test_json_and_templates(spark):
    assert json.loads(X.first_json('say {"a": {"b": 1}} and {}')) == {"a": {"b": 1}} and X.first_json("{bad}") is None and X.first_json("none") is None
    assert X.lenient_json('{a: 1, "b": 2.5, c: {d: true}, e: null, f: "x"}') == {"a": 1, "b": 2.5, "c": {"d": True}, "e": None, "f": "x"}
    assert json.loads(X.response_json("a: 1, b: two")) == {"a": 1, "b": "two"} and X.response_json("nothing") is None
    assert X.filled("{a}{{x}} {b}", {"a": "1", "b": "2"}) == "1{x} 2"
    with pytest.raises(KeyError):
        X.filled("{c}", {})
    assert value(spark, X.filled_column("{a}-{{}}-{b}", a=F.lit("1"), b=F.lit("2"))) == "1-{}-2"
    assert value(spark, X.keyword_lists(F.lit('{"high_level_keywords": ["a"], "low_level_keywords": []}')))["high"] == ["a"]
    assert value(spark, X.keyword_lists(F.lit('{"high_level_keywords": ["a"], "low_level_keywords": [], "x": 1}'))) is None
    assert value(spark, X.first_json_column(F.lit('x {"b": 1, "a": 2}'))) == '{"a": 2, "b": 1}'


def test_keys_and_numbers(spark):
    assert X.call_hash("m", [{"role": "user", "content": "it's\n\"x\""}]) == __import__("hashlib").md5(repr(("m", [{"role": "user", "content": "it's\n\"x\""}])).encode()).hexdigest()
    assert X.call_hash("m'", [{"role": "r", "content": "\x01 tab\t"}]) == __import__("hashlib").md5(repr(("m'", [{"role": "r", "content": "\x01 tab\t"}])).encode()).hexdigest()
    assert [X.python_float(v) for v in (1.0, 2.5, -3.0)] == ["1.0", "2.5", "-3.0"] and X.rounded(2.675) == 2.67
    assert value(spark, X.relation_key(F.lit("b"), F.lit("a"))) == "a<SEP>b" and value(spark, X.relation_ends(F.lit("a<SEP>b"))) == ("a", "b") and value(spark, X.relation_ends(F.lit("a"))) is None
    assert value(spark, X.csv_row(X.cell(F.lit(" 'x' ")), X.cell(F.lit(3), True))) == '"x",\t3'
    assert X.fnv1a("") == 0xCBF29CE484222325 and X.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert [value(spark, X.is_float(F.lit(v))) for v in ("1.5", "-2", ".5", "1.", "x")] == [True, True, True, False, False]
    assert X.canonical_json({"b": 1, "a": [2]}) == '{"a":[2],"b":1}' and len(X.snapshot_hash({})) == 32
    assert value(spark, X.embedding_key(F.lit("w"), F.lit(None).cast("string"), F.lit("t"), "m", F.lit("x"))).startswith("evf-")
    assert value(spark, F.size(X.shingle_hashes(F.array(*[F.lit(c) for c in "abcdef"])))) == 2


def test_tokens_round_trip(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("Hello wörld  \n日本",), (None,), ("",)], "t string")
    rows = df.select("t", tokens.encode(F.col("t"), path).alias("i"), tokens.decode(tokens.encode(F.col("t"), path), path).alias("back"), tokens.count(F.col("t"), path).alias("n")).collect()
    assert all(r["back"] == r["t"] for r in rows) and rows[0]["n"] == len(rows[0]["i"]) and rows[2]["i"] == []


def test_token_windows(spark):
    tokens_ = F.array(*[F.lit(i) for i in range(10)])
    assert [(w["start"], w["tokens"]) for w in value(spark, T.token_windows(tokens_, 4, 1))] == [(0, [0, 1, 2, 3]), (3, [3, 4, 5, 6]), (6, [6, 7, 8, 9]), (9, [9])]
    assert value(spark, T.token_windows(F.array().cast("array<int>"), 4, 1)) == []
