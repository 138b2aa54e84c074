"""Queries of extraction and merging, recall, the knowledge graph, the index, audits, evaluation and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as X
from ..functions import scope as S
from ..functions import text as T
from ..operators import audit as A
from ..operators import evaluation as E
from ..operators import extraction as N
from ..operators import facts as O
from ..operators import index as I
from ..operators import knowledge as K
from ..operators import recall as R
from ..streaming import turns as W
from .base import EDGES, FACTS, PART_GRAPH, STAR, TOKENS, TURNS, fact_edges, facts, part_graph, query, read, star, turns

D = X.TUPLE


@query("""WITH r AS (SELECT 'Customer ' || o_custkey AS n, lower(o_orderstatus) AS t, 'seen ' || o_orderpriority AS d, 'o' || o_orderkey AS s, o_orderkey AS q FROM orders),
k AS (SELECT n, t FROM (SELECT n, t, count(*) AS c, min(q) AS f FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n ORDER BY c DESC, f) = 1),
d AS (SELECT n, string_agg(d, '<SEP>' ORDER BY f) AS d FROM (SELECT n, d, min(q) AS f FROM r GROUP BY ALL) GROUP BY n)
SELECT n AS entity_name, any_value(k.t) AS entity_type, md5(any_value(d.d)) AS description, md5(string_agg(s, '<SEP>' ORDER BY q)) AS source_id, min(q) + 1 AS created_at FROM r JOIN k USING (n) JOIN d USING (n) GROUP BY n""")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a chunk whose result names its customer; the records are parsed, then merged."""
    raw = F.concat(F.lit(f"entity{D}Customer "), F.col("o_custkey").cast("string"), F.lit(D), F.col("o_orderstatus"), F.lit(f"{D}seen "), F.col("o_orderpriority"), F.lit("\n" + X.COMPLETE))
    chunks = read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"), raw.alias("raw"), F.lit("orders").alias("file_path"), (F.col("o_orderkey") + 1).alias("timestamp"), F.col("o_orderkey").alias("seq"))
    entities, _ = N.parse(chunks)
    stored = spark.createDataFrame([], "entity_name string, entity_type string, description string, source_id string, file_path string, created_at long")
    return N.merge_entities(entities, stored).select("entity_name", "entity_type", F.md5("description").alias("description"), F.md5("source_id").alias("source_id"), "created_at")


@query("""WITH r AS (SELECT 'Part ' || l_partkey AS src, 'Supplier ' || l_suppkey AS tgt, 'o' || l_orderkey AS s, l_orderkey * 10 + l_linenumber AS q, l_returnflag AS k FROM lineitem)
SELECT src, tgt, greatest(count(*), count(DISTINCT s))::DOUBLE AS weight, string_agg(DISTINCT k, ', ' ORDER BY k) AS keywords, count(DISTINCT s) AS sources FROM r GROUP BY src, tgt""")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    """Every line item is a chunk whose result joins part and supplier, with the ends in either order."""
    part, supplier = F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    even = F.col("l_linenumber") % 2 == 0
    raw = F.concat(F.lit(f"relation{D}"), F.when(even, part).otherwise(supplier), F.lit(D), F.when(even, supplier).otherwise(part), F.lit(D), F.col("l_returnflag"), F.lit(f"{D}supplied"))
    chunks = read(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("chunk_id"), raw.alias("raw"), F.lit("lineitem").alias("file_path"), F.col("l_orderkey").alias("timestamp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    _, relations = N.parse(chunks)
    stored = spark.createDataFrame([], "src string, tgt string, weight double, source_id string, description string, keywords string")
    return N.merge_relations(relations, stored).select("src", "tgt", "weight", "keywords", F.size(F.split("source_id", X.SEP)).cast("long").alias("sources"))


_CAP = "WITH o AS (SELECT o_custkey AS k, 'o' || o_orderkey AS s, o_orderkey AS q FROM orders), n AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY q{}) AS r, q FROM o) SELECT k AS entity_name, string_agg(s, ',' ORDER BY q) AS chunks FROM n WHERE r <= 5 GROUP BY k"


def _tracking(spark: SparkSession, d: str, keep_first: bool) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("entity_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("pos"))
    stored = spark.createDataFrame([], "entity_name long, chunks array<string>")
    return N.tracking(rows, stored, ["entity_name"], 5, keep_first).select("entity_name", F.array_join("chunks", ",").alias("chunks"))


@query(_CAP.format(""))
def tracking_cap_keep(spark: SparkSession, d: str) -> DataFrame:
    return _tracking(spark, d, True)


@query(_CAP.format(" DESC"))
def tracking_cap_fifo(spark: SparkSession, d: str) -> DataFrame:
    return _tracking(spark, d, False)


@query("SELECT 'ent-' || md5(c_name) AS id, c_name || chr(10) || c_mktsegment AS content, c_name AS entity_name FROM customer")
def entity_vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.entity_vectors(read(spark, d, "customer").select(F.col("c_name").alias("entity_name"), F.col("c_mktsegment").alias("description")))


@query(f"WITH {PART_GRAPH} SELECT src || '<SEP>' || tgt AS key, 'rel-' || md5(src || tgt) AS forward, 'rel-' || md5(tgt || src) AS backward FROM part_graph")
def relation_vector_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = N.relation_vectors(part_graph(spark, d).select("src", "tgt", F.lit("k").alias("keywords"), F.lit("d").alias("description")))
    return rows.select(X.relation_key(F.col("src"), F.col("tgt")).alias("key"), F.get("ids", F.lit(0)).alias("forward"), F.get("ids", F.lit(1)).alias("backward"))


@query(f"""WITH {FACTS}, s AS (SELECT id, {TOKENS} AS t FROM facts WHERE ws = 'w1'), g AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (list_contains(t, 'the')) AS d1, count(*) FILTER (list_contains(t, 'and')) AS d2 FROM s),
x AS (SELECT id, len(t) AS l, len(list_filter(t, lambda w: w = 'the')) AS f1, len(list_filter(t, lambda w: w = 'and')) AS f2 FROM s WHERE list_contains(t, 'the') AND list_contains(t, 'and')),
r AS (SELECT id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM x, g)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 40""")
def recall_bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(facts(spark, d).where(S.admits("w1")), "The and", 40).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {EDGES}, seeds AS (SELECT id FROM facts WHERE turn = 2), b AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), n AS (SELECT id FROM seeds UNION SELECT b.b FROM b JOIN seeds ON b.a = seeds.id)
SELECT DISTINCT src, dst, rel FROM edges WHERE src IN (FROM n) OR dst IN (FROM n)""")
def graph_walk_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a walk of two hops from every third turn's fact meets."""
    return R.edges_of(fact_edges(spark, d), facts(spark, d).where("turn = 2").select("id"), 2).select("src", "dst", "rel")


@query(f"WITH {PART_GRAPH}, h AS (SELECT 's' || s_suppkey AS n, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier QUALIFY rank <= 5) SELECT least(src, tgt) AS a, greatest(src, tgt) AS b FROM part_graph WHERE src IN (SELECT n FROM h) OR tgt IN (SELECT n FROM h)")
def kg_entity_arm(spark: SparkSession, d: str) -> DataFrame:
    """Edges at the five suppliers with the highest balance, which stand for hits of the entity index."""
    top = read(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_name"), F.monotonically_increasing_id().alias("rank"))
    nodes = part_graph(spark, d).select(F.explode(F.array("src", "tgt")).alias("entity_name")).distinct()
    _, edges = K.entity_rows(top, nodes, part_graph(spark, d))
    return edges.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"))


@query("""WITH n AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: length(w) >= 11)) AS name FROM benchmark)
SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) // length(name)) AS count FROM documents JOIN n ON contains(text, name)""")
def index_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Long words of the benchmark as names, all documents as passages."""
    words = read(spark, d, "benchmark").select(F.explode(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.char_length(w) >= 11)).alias("name")).distinct()
    found = I.mentions(read(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text"), words.select(F.col("name").alias("entity_id"), "name"))
    return found.select(F.col("passage_id").alias("doc_id"), "name", "count")


_NAMED = "m AS (SELECT story, entity_id, title, name, CASE doc_type WHEN 'draft' THEN 'drafts' ELSE doc_type END AS doc_type, doc_type || '/' || story AS path FROM star)"


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    s = star(spark, d)
    return s.select("story", "entity_id", "title", "name", F.lit("user").alias("category"), F.when(F.col("doc_type") == "draft", "drafts").otherwise(F.col("doc_type")).alias("doc_type"), F.concat("doc_type", F.lit("/"), "story").alias("path"), F.concat("doc_type", F.lit("/"), "story").alias("document_id"))


@query(f"WITH {STAR}, {_NAMED} SELECT title, path, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m GROUP BY entity_id, title, path HAVING count(DISTINCT name) >= 2")
def index_alias_mixing(spark: SparkSession, d: str) -> DataFrame:
    return I.suspects(_mentioned(spark, d)).where("kind = 'alias_mixing'").select("title", "path", F.array_join("names", ",").alias("names"))


@query(f"""WITH {STAR}, {_NAMED}, g AS (SELECT story, title, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (doc_type IN ('arc-plan', 'story-plan', 'chapter-plan')) AS p, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (doc_type = 'drafts') AS d FROM m GROUP BY ALL)
SELECT story, title, p AS plan_names, d AS draft_names FROM g WHERE p IS NOT NULL AND d IS NOT NULL AND p <> d""")
def index_alias_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = I.alias_drift(_mentioned(spark, d))
    return rows.select("story", "title", F.array_join("plan_names", ",").alias("plan_names"), F.array_join("draft_names", ",").alias("draft_names"))


_HIST = "h AS (SELECT ['false_positive', 'designed_keep', 'confirmed', 'watch'][(event_id % 4 + 1)::INT] AS decision, fact_type AS category, story FROM star)"


@query(f"WITH {STAR}, {_HIST}, n AS (SELECT decision, CASE WHEN decision IN ('false_positive', 'designed_keep') THEN category ELSE story END AS name, count(*) AS n FROM h GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY decision ORDER BY n DESC, name) = 1")
def index_backlog(spark: SparkSession, d: str) -> DataFrame:
    decision = F.element_at(F.array(*[F.lit(x) for x in ("false_positive", "designed_keep", "confirmed", "watch")]), (F.col("event_id") % 4 + 1).cast("int"))
    return I.backlog(star(spark, d).select(decision.alias("decision"), F.col("fact_type").alias("category"), "story"))


_TERMS = (("article", "the", 40.0), ("article", "la", 40.0), ("link", "and", 20.0), ("link", "und", 20.0))


@query("WITH t(category, term, most) AS (VALUES " + ", ".join(f"('{c}', '{t}', {m})" for c, t, m in _TERMS) + """), d AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS chars FROM documents),
m AS (SELECT doc_id, category, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n, chars, most FROM d, t WHERE contains(text, term))
SELECT doc_id, category, term, n AS count, n * 10000.0 / chars > most AS warn FROM m""")
def audit_term_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.term_metrics(read(spark, d, "documents"), list(_TERMS)).select("doc_id", "category", "term", "count", "warn")


@query(f"""WITH {TURNS}, q AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ['the', 'zzzz'] ELSE ['and'] END AS e, content FROM turns) SELECT conv_id AS case_id, turn AS query_id, round(len(list_filter(e, lambda m: contains(content, m))) / len(e), 6) AS recall, len(list_filter(e, lambda m: contains(content, m))) < len(e) AS missed, contains(content, 'que') AS wrong FROM q""")
def eval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a query whose one hit is its own text."""
    t = turns(spark, d)
    expected = F.when(F.col("turn") % 3 == 0, F.array(F.lit("the"), F.lit("zzzz"))).otherwise(F.array(F.lit("and")))
    cases = t.select(F.col("conv_id").alias("case_id"), F.lit("tuning").alias("set"), F.col("turn").alias("query_id"), expected.alias("expected"), F.array(F.lit("que")).alias("forbidden"), F.lit(1).alias("top_k"))
    hits = t.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("query_id"), F.lit(1).alias("rank"), F.col("content").alias("summary"))
    return E.quality(cases, hits).select("case_id", "query_id", F.round("recall", 6).alias("recall"), "missed", "wrong")


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY 1) SELECT event_type, s[len(s) // 2 + 1] AS p50, s[len(s) * 95 // 100 + 1] AS p95, len(s) AS samples FROM s")
def eval_latency(spark: SparkSession, d: str) -> DataFrame:
    r = E.latency(read(spark, d, "events"), ["event_type"], "value")
    return r.select("event_type", "p50", "p95", F.col("samples").cast("long").alias("samples"))


@query("SELECT doc_id, round(('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0, 9) AS u FROM documents")
def eval_draws(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(E.draw_column(F.col("doc_id").cast("string")), 9).alias("u"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of an hour; an extension, as a batch here and as a stream in the tests."""
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return W.windows(e, "ts", "1 hour", keys=("event_type",)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"WITH {TURNS} SELECT 'turn-' || md5(conversation_id || chr(1) || turn_id) AS chunk_id, md5(role || ': ' || content) AS content FROM turns")
def stream_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.chunk_rows(turns(spark, d)).select("chunk_id", F.md5("content").alias("content"))


@query(f"""WITH {FACTS}, n AS (SELECT id || '-new' AS id, id AS old, created_at + 10 AS created_at FROM facts WHERE turn = 2 AND superseded_by IS NULL)
SELECT f.id, CASE WHEN n.id IS NOT NULL THEN n.id ELSE f.superseded_by END AS superseded_by, CASE WHEN n.id IS NOT NULL THEN n.created_at ELSE f.valid_to END AS valid_to, (CASE WHEN n.id IS NOT NULL THEN 2 ELSE 1 END)::BIGINT AS revision FROM facts f LEFT JOIN n ON n.old = f.id UNION ALL SELECT id, NULL, NULL, 1 FROM n""")
def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    """New facts come in and close the old ones, in one table."""
    f = facts(spark, d)
    null = lambda c: F.lit(None).cast(f.schema[c].dataType)
    new = f.where("turn = 2 AND superseded_by IS NULL").withColumn("supersedes", F.col("id")).withColumns({"id": F.concat("id", F.lit("-new")), "created_at": F.col("created_at") + 10, "superseded_by": null("superseded_by"), "valid_to": null("valid_to")})
    return O.replace_facts(f, new).select("id", "superseded_by", "valid_to", "revision")


@query("""WITH a AS (SELECT c_custkey AS k, md5(c_mktsegment) AS h FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, md5(CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_mktsegment END) AS h FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.k, b.k)::VARCHAR AS slot, CASE WHEN a.h IS NULL THEN 'fresh' WHEN b.h IS NULL THEN 'gone' WHEN a.h = b.h THEN 'unchanged' ELSE 'supersede' END AS action FROM a FULL JOIN b ON a.k = b.k""")
def dml_slots(spark: SparkSession, d: str) -> DataFrame:
    """Two states of one corpus that differ in slots and contents."""
    c = read(spark, d, "customer")
    side = lambda w, text: c.where(w).select(F.lit("w").alias("ws"), F.col("c_custkey").cast("string").alias("slot"), F.md5(text).alias("content_hash"))
    return O.slots(side("c_custkey % 5 <> 0", F.col("c_mktsegment")), side("c_custkey % 11 <> 0", F.when(F.col("c_custkey") % 7 == 0, "new").otherwise(F.col("c_mktsegment")))).select("slot", "action")


@query(r"SELECT doc_id, len(w) AS n_shingles FROM (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(t) - 3, 2)), lambda i: array_to_string(t[i:i + 4], ' '))) AS w FROM (SELECT doc_id, " + TOKENS + " AS t FROM documents) WHERE len(t) > 0)")
def fn_shingle_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size(X.shingle_hashes(F.col("t"))).cast("long").alias("n_shingles"))
