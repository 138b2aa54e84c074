"""Queries of the fact store, recall and the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope as S
from ..operators import facts as O
from ..operators import graph as G
from ..operators import retrieval as R
from .base import EDGES, FACTS, PART_GRAPH, TURNS, fact_edges, facts, part_graph, query, read, turns


@query(f"WITH {FACTS} SELECT id, kind, created_at FROM facts WHERE ws = 'w1' AND task = 'a'")
def filter_scope_admits(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where(S.admits("w1", task="a")).select("id", "kind", "created_at")


@query(f"WITH {FACTS} SELECT id, kind FROM facts WHERE ws = 'w1' AND sess = '5' AND task = ''")
def filter_scope_exact(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where(S.exactly("w1", "5")).select("id", "kind")


@query(f"WITH {FACTS} SELECT id, ws FROM facts WHERE superseded_by IS NULL AND valid_to IS NULL AND trust_state <> 'Rejected'")
def filter_current_view(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where(S.is_current()).select("id", "ws")


@query(f"WITH {FACTS} SELECT id, len(list_distinct(sessions)) AS n_sessions FROM facts WHERE NOT (5000000 - created_at > 1000000 AND len(list_distinct(sessions)) < 2)")
def filter_staleness(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).where(~S.stale(5000000, 1000000, 2))
    return f.select("id", F.size(F.array_distinct(F.col("source_refs.session_id"))).cast("long").alias("n_sessions"))


@query(f"WITH {TURNS} SELECT conversation_id, turn_id FROM turns WHERE timestamp >= 1000000 AND timestamp <= 4000001")
def filter_time_window(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where(S.in_window(F.col("timestamp"), 1000000, 4000001)).select("conversation_id", "turn_id")


_MARKS = "marks AS (SELECT conversation_id, turn_id AS last_turn_id, timestamp AS last_timestamp FROM turns WHERE turn = 2 AND conv_id % 3 = 0)"


@query(f"WITH {TURNS}, {_MARKS} SELECT t.conversation_id, t.turn_id, t.timestamp FROM turns t LEFT JOIN marks m USING (conversation_id) WHERE NOT coalesce(t.turn_id = last_turn_id OR t.timestamp <= last_timestamp, false)")
def stream_pending_tail(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    marks = t.where("turn = 2 AND conv_id % 3 = 0").select("conversation_id", F.col("turn_id").alias("last_turn_id"), F.col("timestamp").alias("last_timestamp"))
    return O.pending(t, marks).select("conversation_id", "turn_id", "timestamp")


@query(f"WITH {TURNS}, {_MARKS}, n AS (SELECT conversation_id, turn_id AS last_turn_id, timestamp AS last_timestamp FROM turns UNION ALL FROM marks) SELECT conversation_id, arg_max(last_turn_id, last_timestamp) AS last_turn_id, max(last_timestamp) AS last_timestamp FROM n GROUP BY 1")
def stream_advance_marks(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    marks = t.where("turn = 2 AND conv_id % 3 = 0").select("conversation_id", F.col("turn_id").alias("last_turn_id"), F.col("timestamp").alias("last_timestamp"))
    return O.advance(marks, t)


@query(f"WITH {FACTS}, b AS (SELECT id, ws, 'new' AS text, revision + 1 AS revision FROM facts WHERE turn = 1) SELECT id, ws, text, revision::BIGINT AS revision FROM b UNION ALL SELECT id, ws, text, revision FROM facts WHERE id NOT IN (SELECT id FROM b)")
def dml_put_many(spark: SparkSession, d: str) -> DataFrame:
    """A batch that holds each key twice; the later row wins."""
    f = facts(spark, d)
    store = f.select("id", "ws", "text", "revision")
    new = f.where("turn = 1").select("id", "ws", F.explode(F.array(F.struct(F.lit("old").alias("text"), F.lit(0).alias("seq")), F.struct(F.lit("new").alias("text"), F.lit(1).alias("seq")))).alias("x"), (F.col("revision") + 1).alias("revision"))
    return O.put(store, new.select("id", "ws", "x.text", "revision", "x.seq"), ["id"], "seq")


@query(f"""WITH {FACTS} SELECT id, CASE WHEN superseded_by IS NULL AND turn = 2 THEN id || '-new' ELSE superseded_by END AS superseded_by, CASE WHEN superseded_by IS NULL AND turn = 2 THEN created_at + 10 ELSE valid_to END AS valid_to,
  (CASE WHEN superseded_by IS NULL AND turn = 2 THEN 2 ELSE 1 END)::BIGINT AS revision FROM facts""")
def dml_supersede(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    pairs = f.where("turn = 2").select(F.col("id").alias("old_id"), F.concat("id", F.lit("-new")).alias("new_id"), (F.col("created_at") + 10).alias("at"))
    return O.supersede(f, pairs).select("id", "superseded_by", "valid_to", "revision")


@query(rf"""WITH {FACTS}, k AS (SELECT *, md5(ws || chr(1) || sess || chr(1) || task || chr(1) || lower(regexp_replace(text, '\s+', ' ', 'g'))) AS tombstone FROM facts), bad AS (SELECT DISTINCT tombstone FROM k WHERE turn = 3)
SELECT id, CASE WHEN turn = 3 THEN 'Rejected' ELSE trust_state END AS trust_state, tombstone IN (FROM bad) AS screened FROM k""")
def dml_reject_tombstone(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    store, stones = O.reject(f, f.where("turn = 3"))
    kept = O.screen(f, stones).select("id").withColumn("free", F.lit(True))
    return store.join(kept, "id", "left").select("id", "trust_state", F.col("free").isNull().alias("screened"))


_CITED = "superseded_by IS NULL AND valid_to IS NULL AND trust_state <> 'Rejected' AND len(list_filter(list_zip(sessions, events), lambda r: (r[1] = 's3' AND r[2] LIKE '%:2:0') OR (r[1] = 's4' AND r[2] LIKE '8:%:1'))) > 0"


@query(f"WITH {FACTS} SELECT id, CASE WHEN {_CITED} THEN 99 ELSE valid_to END AS valid_to, (CASE WHEN {_CITED} THEN 2 ELSE 1 END)::BIGINT AS revision FROM facts")
def dml_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """All events of session s3 that end in :2:0, and those of s4 in conversation 8 that end in :1, whichever facts cite them."""
    f = facts(spark, d)
    events = f.select(F.explode("source_refs").alias("r")).select("r.*").distinct().where("(session_id = 's3' AND event_id LIKE '%:2:0') OR (session_id = 's4' AND event_id LIKE '8:%:1')")
    return O.invalidate(f, events, 99).select("id", "valid_to", "revision")


@query(f"""WITH {FACTS} SELECT id, CASE WHEN turn % 2 = 1 AND trust_state = 'Trusted' AND len(list_distinct(list_append(sessions, 's9'))) >= 2 THEN 'Corroborated' ELSE trust_state END AS trust_state,
  len(sessions) + CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END AS n_refs FROM facts""")
def dml_corroborate(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    refs = f.where("turn % 2 = 1").select("id", F.lit("s9").alias("session_id"), F.concat(F.lit("again:"), "id").alias("event_id"))
    return O.corroborate(f, refs.union(refs)).select("id", "trust_state", F.size("source_refs").cast("long").alias("n_refs"))


@query("WITH e AS (SELECT DISTINCT 'p' || l_partkey AS element, l_orderkey AS chunk_id FROM lineitem), l AS (SELECT * FROM e WHERE chunk_id % 5 <> 0) SELECT element, count(l.chunk_id) AS n_left, count(l.chunk_id) = 0 AS removed FROM e LEFT JOIN l USING (element, chunk_id) GROUP BY element")
def dml_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Parts are the elements, orders the chunks; every fifth order goes."""
    li = read(spark, d, "lineitem")
    e = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("element"), F.col("l_orderkey").alias("chunk_id")).distinct()
    left, gone = O.cascade_sources(e, li.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("chunk_id")))
    n = left.groupBy("element").agg(F.count("*").alias("n_left")).withColumn("removed", F.lit(False))
    return n.union(gone.select("element", F.lit(0).cast("long").alias("n_left"), F.lit(True).alias("removed")))


@query("WITH w(pos, k) AS (VALUES (0, 5::BIGINT), (1, 999999999), (2, 1), (3, 5)) SELECT pos, k AS c_custkey, c_name FROM w LEFT JOIN customer ON c_custkey = k")
def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, 5), (1, 999999999), (2, 1), (3, 5)], "pos int, c_custkey long")
    return O.multi_get(read(spark, d, "customer").select("c_custkey", "c_name"), wanted, "c_custkey").select("pos", "c_custkey", "c_name")


@query("SELECT o_custkey AS missing, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def kv_filter_keys(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "customer").where("c_custkey % 2 = 0")
    return read(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy(F.col("o_custkey").alias("missing")).agg(F.count("*").alias("n"))


_QUERY = "the tion que der les und con para"
_QTOKENS = "['the', 'tion', 'que', 'der', 'les', 'und', 'con', 'para']"
_FTOK = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''))"
_LEX = f"lex AS (SELECT id, len(list_intersect({_QTOKENS}, {_FTOK})) / 8.0 AS score FROM facts WHERE superseded_by IS NULL AND valid_to IS NULL AND trust_state <> 'Rejected'), lexr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0 QUALIFY rank <= 40)"


@query(f"WITH {FACTS}, {_LEX} SELECT id, score::DOUBLE AS score, rank FROM lexr")
def recall_lexical_arm(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical(facts(spark, d).where(S.is_current()), _QUERY, 40)


@query(rf"WITH {FACTS}, t AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS t FROM facts) SELECT id, len(list_filter(t, lambda x: x IN ('the', 'and'))) AS score FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'and')")
def recall_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    r = R.all_tokens(facts(spark, d), ["the", "and"])
    return r.select("id", F.col("score").cast("long").alias("score"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 20")
def recall_vector_arm(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.nearest(v, v.where("id = 7").select("vector"), 20).select("id", F.round("score", 6).alias("score"), "rank")


@query("WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s WHERE score >= 0.3 QUALIFY rank <= 5")
def recall_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return R.neighbours(v, "label", 5, 0.3).select("id", "other", F.round("score", 6).alias("score"), "rank")


_GRAPH = """seeds AS (SELECT id FROM lexr WHERE rank <= 10), bothways AS (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges),
h1 AS (SELECT DISTINCT other AS id FROM bothways JOIN seeds USING (id)), n1 AS (SELECT id FROM seeds UNION SELECT id FROM h1), h2 AS (SELECT DISTINCT other AS id FROM bothways JOIN n1 USING (id)), near AS (SELECT id FROM n1 UNION SELECT id FROM h2),
inside AS (SELECT DISTINCT src, dst, rel, weight FROM edges WHERE src IN (FROM near) AND dst IN (FROM near)),
gs AS (SELECT id, sum(w) AS score FROM (SELECT src AS id, weight * CASE rel WHEN 'Corrects' THEN 1.5 ELSE 1.0 END AS w FROM inside UNION ALL SELECT dst, weight * CASE rel WHEN 'Corrects' THEN 1.5 ELSE 1.0 END FROM inside) GROUP BY id),
gr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM gs QUALIFY rank <= 40)"""


def _graph_arm(spark: SparkSession, d: str, lex: DataFrame) -> DataFrame:
    e = fact_edges(spark, d)
    near = R.hops(e, lex.where("rank <= 10"), 2)
    return R.ranked(R.graph_scores(e, near), 40)


@query(f"WITH {EDGES}, {_LEX}, {_GRAPH} SELECT id, score::DOUBLE AS score, rank FROM gr")
def recall_graph_arm(spark: SparkSession, d: str) -> DataFrame:
    return _graph_arm(spark, d, R.lexical(facts(spark, d).where(S.is_current()), _QUERY, 40))


@query(f"""WITH {EDGES}, {_LEX}, {_GRAPH}, f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s, string_agg(arm, '+' ORDER BY arm DESC) AS via FROM (SELECT id, rank, 'lexical' AS arm FROM lexr UNION ALL SELECT id, rank, 'graph' FROM gr) GROUP BY id), o AS (SELECT id, round(s, 9) AS score, via FROM f ORDER BY score DESC, id LIMIT 30)
SELECT o.id, score, via, kind FROM o JOIN facts USING (id) WHERE superseded_by IS NULL AND valid_to IS NULL AND trust_state <> 'Rejected'""")
def recall_fused(spark: SparkSession, d: str) -> DataFrame:
    """Both arms fused by reciprocal ranks, then the current facts of the best 30."""
    f = facts(spark, d)
    lex = R.lexical(f.where(S.is_current()), _QUERY, 40)
    fused = R.fuse({"lexical": lex, "graph": _graph_arm(spark, d, lex)}, 30)
    return fused.join(f.where(S.is_current()), "id").select("id", "score", "via", "kind")


@query(f"WITH {EDGES}, {_LEX}, {_GRAPH} SELECT id, min(p) AS place FROM (SELECT id, rank * 2 AS p FROM lexr UNION ALL SELECT id, rank * 2 + 1 FROM gr) GROUP BY id")
def win_round_robin(spark: SparkSession, d: str) -> DataFrame:
    lex = R.lexical(facts(spark, d).where(S.is_current()), _QUERY, 40)
    return R.round_robin(lex, _graph_arm(spark, d, lex))


@query(f"WITH {EDGES}, {_LEX}, {_GRAPH} SELECT id, CASE WHEN id IN (FROM seeds) THEN 0 WHEN id IN (FROM h1) THEN 1 ELSE 2 END AS hop FROM near")
def graph_hops(spark: SparkSession, d: str) -> DataFrame:
    lex = R.lexical(facts(spark, d).where(S.is_current()), _QUERY, 40)
    return R.hops(fact_edges(spark, d), lex.where("rank <= 10"), 2)


@query(f"WITH {PART_GRAPH}, e AS (SELECT src AS node FROM part_graph UNION ALL SELECT tgt FROM part_graph) SELECT node, count(*) AS degree FROM e GROUP BY node")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(part_graph(spark, d))


@query(f"WITH {PART_GRAPH}, e AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM part_graph UNION ALL SELECT tgt FROM part_graph) GROUP BY node) SELECT src, tgt, a.degree + b.degree AS degree FROM part_graph JOIN e a ON a.node = src JOIN e b ON b.node = tgt")
def graph_edge_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_degree(part_graph(spark, d))


@query("WITH e AS (SELECT n_name AS src, r_name AS tgt, s_acctbal AS weight, s_suppkey AS seq FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, arg_max(weight, seq) AS weight FROM e WHERE src <> tgt GROUP BY 1, 2")
def graph_undirected(spark: SparkSession, d: str) -> DataFrame:
    n, r, s = (read(spark, d, t) for t in ("nation", "region", "supplier"))
    e = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("tgt"), F.col("s_acctbal").alias("weight"), F.col("s_suppkey").alias("seq"))
    return G.undirected(e)


_REACH = f"WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), w(node, seen) AS (SELECT a, a FROM b UNION SELECT w.node, b.b FROM w JOIN b ON w.seen = b.a), c AS (SELECT node, min(seen) AS component FROM w GROUP BY node)"


@query(f"{_REACH} SELECT node, component FROM c")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the whole fact graph."""
    return G.components(fact_edges(spark, d).select("src", F.col("dst").alias("tgt")))


@query(f"{_REACH}, s AS (SELECT component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 1) SELECT node, component, n FROM c JOIN s USING (component)")
def graph_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return G.largest_component(fact_edges(spark, d).select("src", F.col("dst").alias("tgt")))


@query("""WITH r AS (SELECT 'c' || (o_custkey % 200) AS name, o_orderpriority AS type, o_orderstatus AS source_id, o_orderkey AS seen FROM orders), t AS (SELECT name, type, count(*) AS n, min(seen) AS first FROM r GROUP BY ALL), b AS (SELECT name, type FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, first) = 1)
SELECT name, any_value(b.type) AS type, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources, min(seen) AS created_at, count(*) AS records FROM r JOIN b USING (name) GROUP BY name""")
def graph_merge_entities(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 200).cast("string")).alias("name"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("source_id"), F.col("o_orderkey").alias("seen"))
    return G.merge_entities(o).select("name", "type", F.array_join("sources", ",").alias("sources"), "created_at", "records")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 50 AS tgt, l_orderkey AS source_id, 1.0::DOUBLE AS weight, l_orderkey % 3 = 0 AS known FROM lineitem) SELECT src, tgt, greatest(sum(weight), count(DISTINCT source_id)::DOUBLE) AS weight, count(DISTINCT source_id) AS sources FROM r GROUP BY src, tgt""")
def graph_merge_relations(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("tgt"), F.col("l_orderkey").alias("source_id"), F.lit(1.0).alias("weight"))
    known = r.where("source_id % 3 = 0").dropDuplicates(["src", "tgt", "source_id"])
    return G.merge_relations(r, known)
