"""Tables derived from the source tables, and the registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("string").alias("turn_id"), "role", F.coalesce("text", F.lit("")).alias("content"), (F.col("conv_id") * 100000 + F.col("turn")).alias("timestamp"), "conv_id", "turn")


def fact_id() -> F.Column:
    return F.concat(F.lit("fact-"), F.md5(F.concat("conversation_id", F.lit("\u0001"), "turn_id")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each turn: some superseded by the next turn's, some rejected, some closed."""
    t = turns(spark, sf_dir)
    after = F.concat(F.lit("fact-"), F.md5(F.concat("conversation_id", F.lit("\u0001"), (F.col("turn") + 1).cast("string"))))
    refs = F.transform(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("s"), ((F.col("conv_id") + i) % 5).cast("string")).alias("session_id"), F.concat("conversation_id", F.lit(":"), "turn_id", F.lit(":"), i.cast("string")).alias("event_id")))
    return t.select(
        fact_id().alias("id"), F.concat(F.lit("w"), (F.col("conv_id") % 4).cast("string")).alias("ws"), F.col("conversation_id").alias("sess"), F.when(F.col("turn") % 2 == 0, F.lit("a")).otherwise(F.lit("")).alias("task"),
        F.when(F.col("role") == "user", "episodic").when(F.col("role") == "assistant", "semantic").otherwise("procedural").alias("kind"), F.col("content").alias("text"), refs.alias("source_refs"),
        F.when(F.col("turn") % 7 == 6, "Rejected").otherwise("Trusted").alias("trust_state"), F.when(F.col("turn") % 6 == 5, F.col("timestamp")).alias("valid_to"), F.col("timestamp").alias("created_at"),
        F.when(F.col("turn") % 5 == 1, after).alias("superseded_by"), F.lit(1).cast("long").alias("revision"), "conv_id", "turn",
    )


def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation, every fifth a correction."""
    a = facts(spark, sf_dir).select("id", "ws", "sess", "conv_id", "turn")
    b = a.select(F.col("id").alias("dst"), F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"))
    j = a.join(b, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")))
    return j.select("ws", "sess", F.col("id").alias("src"), "dst", F.when(F.col("turn") % 5 == 4, "Corrects").otherwise("Related").alias("rel"), F.lit(1.0).alias("weight"))


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of entities in documents: story is the day, entity the user, cue the k of props."""
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("draft"), F.lit("story-plan"), F.lit("chapter-plan")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("story"), F.col("user_id").alias("entity_id"), F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("title"), F.concat(F.lit("E"), F.col("user_id").cast("string"), F.lit("-"), F.when(F.col("event_id") % 97 == 0, F.lit("alias")).otherwise((F.col("event_id") % 2).cast("string"))).alias("name"),
                    kind.alias("doc_type"), F.col("event_type").alias("fact_type"), F.get_json_object("props", "$.k").alias("cue"), F.floor(F.col("event_id") / 20).cast("long").alias("passage_id"), "value")


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight")).select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt"), "weight")


#: The same tables in DuckDB's SQL, for WITH.
TURNS = "turns AS (SELECT conv_id::VARCHAR AS conversation_id, turn::VARCHAR AS turn_id, role, coalesce(text, '') AS content, conv_id * 100000 + turn AS timestamp, conv_id, turn FROM conversations)"
FACTS = TURNS + """, facts AS (SELECT 'fact-' || md5(conversation_id || chr(1) || turn_id) AS id, 'w' || (conv_id % 4) AS ws, conversation_id AS sess, CASE WHEN turn % 2 = 0 THEN 'a' ELSE '' END AS task,
  CASE role WHEN 'user' THEN 'episodic' WHEN 'assistant' THEN 'semantic' ELSE 'procedural' END AS kind, content AS text,
  list_transform(range(0, turn % 3 + 1), lambda i: 's' || ((conv_id + i) % 5)) AS sessions, list_transform(range(0, turn % 3 + 1), lambda i: conversation_id || ':' || turn_id || ':' || i) AS events,
  CASE WHEN turn % 7 = 6 THEN 'Rejected' ELSE 'Trusted' END AS trust_state, CASE WHEN turn % 6 = 5 THEN timestamp END AS valid_to, timestamp AS created_at,
  CASE WHEN turn % 5 = 1 THEN 'fact-' || md5(conversation_id || chr(1) || (turn + 1)) END AS superseded_by, 1 AS revision, conv_id, turn FROM turns)"""
EDGES = FACTS + ", edges AS (SELECT a.ws, a.sess, a.id AS src, b.id AS dst, CASE WHEN a.turn % 5 = 4 THEN 'Corrects' ELSE 'Related' END AS rel, 1.0::DOUBLE AS weight FROM facts a JOIN facts b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
STAR = """star AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS story, user_id AS entity_id, 'E' || user_id AS title, 'E' || user_id || '-' || CASE WHEN event_id % 97 = 0 THEN 'alias' ELSE (event_id % 2)::VARCHAR END AS name,
  ['draft', 'story-plan', 'chapter-plan'][(event_id % 3 + 1)::INT] AS doc_type, event_type AS fact_type, json_extract_string(props, '$.k') AS cue, event_id // 20 AS passage_id, value FROM events)"""
PART_GRAPH = "part_graph AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey)"
#: Macros would need DDL, so token lists are spelled out.
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
