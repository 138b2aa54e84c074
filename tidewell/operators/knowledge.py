"""Queries of the knowledge graph: entity, relation and chunk arms, budgets and the context that a model reads.

Nodes are (entity_name, entity_type, description, source_id, file_path,
created_at), edges (src, tgt, description, keywords, weight, source_id,
file_path, created_at), chunks (chunk_id, content, tokens, file_path,
conversation_id, timestamp); hits of an index are (key columns, rank).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as X
from ..functions import scope as S

MODES = ("local", "global", "hybrid", "mix", "naive")
#: What a query that finds nothing gets; a fixed value.
FAIL = "Sorry, I'm not able to provide an answer to that question.[no-context]"


@dataclass(frozen=True)
class Param:
    """Knobs of a query; the values are fixed defaults."""

    mode: str = "mix"
    top_k: int = 40
    chunk_top_k: int = 20
    entity_tokens: int = 6000
    relation_tokens: int = 8000
    total_tokens: int = 30000
    min_rerank_score: float = 0.0
    conversation_id: str | None = None
    since: int | None = None
    until: int | None = None
    only_context: bool = False


def keywords_for(query: str, high: list[str], low: list[str]) -> tuple[str, str] | None:
    """Texts that the relation and the entity arm look up; a short query (under 50 bytes) without keywords is its own, a long one fails."""
    if not high and not low:
        return ("", query) if len(query.encode()) < 50 else None
    return ", ".join(high), ", ".join(low)


def entity_rows(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the hits (entity_name, rank) with their degree, and every edge at one of them once, by pair; hits without a node go."""
    found = nodes.join(F.broadcast(hits.select("entity_name", "rank")), "entity_name")
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_name")).join(found.select("entity_name"), "entity_name", "left_semi").groupBy("entity_name").agg(F.count("*").alias("degree"))
    names = found.select(F.col("entity_name").alias("n"))
    near = edges.join(names, F.col("src") == F.col("n"), "left_semi").unionByName(edges.join(names, F.col("tgt") == F.col("n"), "left_semi"))
    pair = near.withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")}).dropDuplicates(["a", "b"])
    order = Window.orderBy("a", "b")
    return found.join(ends, "entity_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), pair.withColumn("rank", F.row_number().over(order).cast("long")).drop("a", "b")


def relation_rows(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the hits (src, tgt, rank) in either direction, and the nodes at their ends in the order in which they come first."""
    h = hits.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "rank").groupBy("a", "b").agg(F.min("rank").alias("rank"))
    found = edges.withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")}).join(F.broadcast(h), ["a", "b"]).drop("a", "b")
    first = found.select(F.posexplode(F.array("src", "tgt")).alias("side", "entity_name"), "rank").groupBy("entity_name").agg(F.min(F.struct("rank", "side")).alias("f"))
    order = Window.orderBy("f.rank", "f.side", "entity_name")
    return found, nodes.join(first.withColumn("rank", F.row_number().over(order).cast("long")).drop("f"), "entity_name")


def merged(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two ranked lists in turn, the first one's row first; a key counts at its first place."""
    both = first.select("*", (F.col("rank") * 2).alias("__p")).unionByName(second.select("*", (F.col("rank") * 2 + 1).alias("__p")), allowMissingColumns=True)
    one = both.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__p"))).where("__n = 1").drop("__n")
    return one.withColumn("rank", F.row_number().over(Window.orderBy("__p", *key)).cast("long")).drop("__p")


def within(rows: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """Rows from rank 1 on while their tokens, and one more each, fit the budget; 0 gives none."""
    used = F.sum(tokens + 1).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__used", used).where(F.col("__used") <= budget).drop("__used")


def in_time(rows: DataFrame, param: Param) -> DataFrame:
    """Rows created in the window of seconds; rows without a positive time go if there is a window."""
    if param.since is None and param.until is None:
        return rows
    return rows.where((F.col("created_at") > 0) & S.in_window(F.col("created_at") * 1000, param.since, param.until))


def admitted(chunks: DataFrame, param: Param) -> DataFrame:
    """Chunks of the conversation and window asked for; chunks that don't say theirs go."""
    out = chunks
    if param.conversation_id is not None:
        out = out.where(F.col("conversation_id") == param.conversation_id)
    if param.since is not None or param.until is not None:
        out = out.where(F.col("timestamp").isNotNull() & S.in_window(F.col("timestamp") * 1000, param.since, param.until))
    return out


def chunks_of(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that the elements (source_id) come from, each once, by id."""
    ids = elements.select(F.explode(F.filter(F.split("source_id", X.SEP), lambda s: s != "")).alias("chunk_id")).distinct()
    found = chunks.join(ids, "chunk_id", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.orderBy("chunk_id")).cast("long"))


def chunk_hits(hits: DataFrame, chunks: DataFrame, param: Param) -> DataFrame:
    """Chunks of the hits (chunk_id, rank) in the hits' order; those that are gone or not admitted are left out."""
    found = admitted(chunks.join(F.broadcast(hits.select("chunk_id", "rank")), "chunk_id"), param)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long"))


def fused(rows: DataFrame, param: Param, relevance: Column | None = None) -> DataFrame:
    """Chunks once each, by relevance if a reranker gave one (those below the least go), cut to the top and to the token budget."""
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank"))).where("__n = 1").drop("__n")
    if relevance is not None:
        one = one.withColumn("relevance", relevance).where(F.col("relevance") >= param.min_rerank_score)
    order = [F.desc("relevance"), F.col("rank")] if relevance is not None else [F.col("rank")]
    ranked = one.orderBy(*order, "chunk_id").limit(param.chunk_top_k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order, "chunk_id")).cast("long"))
    return within(ranked, F.col("tokens"), param.total_tokens)


def numbered(rows: DataFrame) -> DataFrame:
    """Chunks with the ids DC1, DC2, ... in order."""
    return rows.withColumn("id", F.concat(F.lit("DC"), F.row_number().over(Window.orderBy("rank")).cast("string")))


def references(rows: DataFrame) -> DataFrame:
    """(number, file_path): the paths of the chunks in the order in which they come first."""
    first = rows.groupBy("file_path").agg(F.min("rank").alias("first"))
    return first.select(F.row_number().over(Window.orderBy("first")).alias("number"), "file_path")


def entity_json(tokens_only: bool = False) -> Column:
    """An entity as the model reads it; what the budget measures leaves time and path out."""
    columns = [F.col("entity_name").alias("entity"), F.col("entity_type").alias("type"), F.col("description")]
    return F.to_json(F.struct(*columns, *([] if tokens_only else ["created_at", "file_path"])))


def relation_json(tokens_only: bool = False) -> Column:
    columns = [F.col("src").alias("entity1"), F.col("tgt").alias("entity2"), F.col("description")]
    return F.to_json(F.struct(*columns, *([] if tokens_only else ["created_at", "file_path"])))


def words(text: Column) -> Column:
    """Tokens of the built-in counter: words and single signs; any other counter may take its place."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0))


def context(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row, context: the three lists as JSON lines and the numbered references; the rows are within their budgets, so one task holds them."""
    lines = lambda rows, what: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", what.alias("j")))), lambda x: x["j"]), "\n").alias("t"))
    e = lines(entities, entity_json()).scalar()
    r = lines(relations, relation_json()).scalar()
    c = lines(chunks, F.to_json(F.struct("id", "content", "file_path"))).scalar()
    refs = references(chunks).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "file_path"))), lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("] "), x["file_path"])), "\n").alias("t")).scalar()
    one = entities.sparkSession.range(1).select(e.alias("e"), r.alias("r"), c.alias("c"), refs.alias("f"))
    return one.select(F.concat(F.lit("Entities:\n"), "e", F.lit("\n\nRelations:\n"), "r", F.lit("\n\nChunks:\n"), "c", F.lit("\n\nReferences:\n"), "f").alias("context"))


def answer_context(param: Param, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, entity_hits: DataFrame, relation_hits: DataFrame, hits: DataFrame, tokens=words) -> dict[str, DataFrame]:
    """entities, relations, chunks and context of a query in the given mode.

    local takes the entity arm, global the relation arm, hybrid both, mix both
    and the chunk hits, naive the chunk hits alone.
    """
    if param.mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}")
    none = lambda df: df.withColumn("rank", F.lit(0).cast("long")).limit(0)
    le, lr = entity_rows(entity_hits, nodes, edges) if param.mode in ("local", "hybrid", "mix") else (none(nodes), none(edges))
    gr, ge = relation_rows(relation_hits, edges, nodes) if param.mode in ("global", "hybrid", "mix") else (none(edges), none(nodes))
    entities = within(in_time(merged(le, ge, ["entity_name"]), param), tokens(entity_json(True)), param.entity_tokens)
    relations = within(in_time(merged(lr, gr, ["src", "tgt"]), param), tokens(relation_json(True)), param.relation_tokens)
    own = none(chunks) if param.mode == "naive" else admitted(merged(chunks_of(entities, chunks), chunks_of(relations, chunks), ["chunk_id"]), param)
    direct = chunk_hits(hits, chunks, param) if param.mode in ("mix", "naive") else none(chunks)
    found = numbered(fused(merged(direct, own, ["chunk_id"]), param))
    return {"entities": entities, "relations": relations, "chunks": found, "context": context(entities, relations, found)}
