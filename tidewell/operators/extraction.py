"""Extraction results to records, records to merged entities and relations, their tracking lists and vector rows.

Chunks are (chunk_id, raw, file_path, timestamp, seq); seq orders them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as X

#: Fragments from which, and tokens beyond which, a description is summarised, and the context of one summary; fixed values.
SUMMARY_FRAGMENTS, SUMMARY_TOKENS, SUMMARY_CONTEXT = 8, 1200, 12000


def parse(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relation records of the chunks' raw extraction results, in their order (seq, pos).

    An entity has four fields and a name and type that stay after
    normalisation; a relation has five, two different names and a description.
    """
    fields = F.transform(X.rows(F.col("raw")), X.attributes)
    at = lambda a, i: F.get(a, F.lit(i))

    def records(size: int, mark: str, **made: Callable[[Column], Column]) -> DataFrame:
        # fields are made within the array, once for each row: filters on columns would make them again
        one = lambda a: F.when((F.size(a) == size) & F.contains(at(a, 0), F.lit(mark)), F.struct(*[f(a).alias(k) for k, f in made.items()]))
        found = chunks.select("seq", F.col("chunk_id").alias("source_id"), "file_path", "timestamp", F.posexplode(F.transform(fields, one)).alias("pos", "x")).where("x IS NOT NULL")
        return found.select("x.*", "seq", "pos", "source_id", "file_path", "timestamp")

    entities = records(4, "entity", entity_name=lambda a: X.normalized(at(a, 1), True), entity_type=lambda a: F.get(F.transform(F.array(X.normalized(at(a, 2), True)), X.entity_type), F.lit(0)), description=lambda a: X.normalized(at(a, 3)))
    entities = entities.where("entity_name <> '' AND entity_type IS NOT NULL")
    relations = records(5, "relation", src=lambda a: X.normalized(at(a, 1), True), tgt=lambda a: X.normalized(at(a, 2), True), keywords=lambda a: F.replace(X.normalized(at(a, 3), True), F.lit("，"), F.lit(",")), description=lambda a: X.normalized(at(a, 4)))
    relations = relations.where("src <> '' AND tgt <> '' AND src <> tgt AND trim(description) <> ''").withColumn("weight", F.lit(1.0))
    return entities, relations.withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})


def _in_order(value: str | Column, *order: str | Column) -> Column:
    """Values of a group in order, the first of equal ones."""
    named = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], (F.col(value) if isinstance(value, str) else value).alias("v"))
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["v"]))


def _by_description(records: DataFrame, keys: list[str], *lists: Column, among: tuple[str, ...] = ()) -> DataFrame:
    """Groups by the keys, among and the description: f, the first (seq, pos, timestamp), s, the sources with their places, and lists.

    All rows of a key come to one partition, so later groups by fewer columns
    move nothing more and what made the records runs once.
    """
    first, sources = F.min(F.struct("seq", "pos", "timestamp")).alias("f"), F.collect_list(F.struct("seq", "pos", "source_id", *[x for x in ("weight",) if x in records.columns])).alias("s")
    return records.repartition(*keys).groupBy(*keys, *among, "description").agg(first, sources, *lists)


def _descriptions() -> Column:
    """New descriptions of a key from its groups by description, by timestamp and falling length."""
    one = F.struct(F.col("f.timestamp"), (-F.octet_length("description")).alias("size"), F.col("f.seq"), F.col("f.pos"), F.col("description").alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("description") != "", one))), lambda x: x["v"]).alias("new_descriptions")


def _together(lists: str) -> Column:
    return F.flatten(F.collect_list(lists)).alias(lists)


def _in_place(places: str, value: str) -> Column:
    """Values of structs that begin with their place, in order, the first of equal ones."""
    return F.array_distinct(F.transform(F.array_sort(places), lambda x: x[value]))


def _most_frequent(kinds: Column) -> Column:
    """The type of the largest sum of n, ties to the first; kinds: (seq, pos, n, entity_type)."""
    types = F.array_distinct(F.transform(kinds, lambda k: k["entity_type"]))

    def rated(t: Column) -> Column:
        own = F.filter(kinds, lambda k: k["entity_type"] == t)
        return F.struct((-F.aggregate(own, F.lit(0).cast("long"), lambda n, k: n + k["n"])).alias("n"), F.array_min(F.transform(own, lambda k: F.struct(k["seq"], k["pos"]))).alias("f"), t.alias("entity_type"))

    return F.array_min(F.transform(types, rated))["entity_type"]


def _new_weight(sources: str, stored: Column) -> Column:
    """Sum of the weights of sources that aren't stored ones: both in one order by name, where a stored one comes first."""
    at = lambda name, new, weight: F.struct(name.alias("name"), F.lit(new).alias("new"), weight.cast("double").alias("weight"))
    both = F.array_sort(F.concat(F.transform(stored, lambda x: at(x, 0, F.lit(0.0))), F.transform(F.col(sources), lambda x: at(x["source_id"], 1, F.coalesce(x["weight"], F.lit(0.0))))))
    start = F.struct(F.lit(None).cast("string").alias("known"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct(F.when(x["new"] == 0, x["name"]).otherwise(s["known"]).alias("known"), F.when(x["name"] == s["known"], s["sum"]).otherwise(s["sum"] + x["weight"]).alias("sum"))
    return F.when(F.size(stored) > 0, F.aggregate(both, start, step)["sum"]).otherwise(F.aggregate(F.col(sources), F.lit(0.0), lambda s, x: s + F.coalesce(x["weight"], F.lit(0.0))))


def _split(joined: Column) -> Column:
    return F.filter(F.split(F.coalesce(joined, F.lit("")), X.SEP), lambda x: x != "")


def _combined(stored: Column, new: Column) -> Column:
    """Stored and new fragments, normalised, without empty and equal ones."""
    parts = F.concat(F.when(stored.isNotNull(), F.array(stored)).otherwise(F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: X.normalized(x)), lambda x: x != ""))


def needs_summary(fragments: Column, tokens: Column) -> Column:
    """Whether the joined fragments go to a model; fewer than eight within the token limit are only joined."""
    return (F.size(fragments) >= SUMMARY_FRAGMENTS) | (tokens > SUMMARY_TOKENS)


def merge_entities(records: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each entity with records, as it is stored next.

    stored: (entity_name, entity_type, description, source_id, file_path,
    created_at).  The type is the most frequent of new and stored ones, ties
    to the first; sources are new ones in order, then stored; descriptions
    stored ones, then new by time and length; the time the first positive one.
    """
    key, place = ["entity_name"], (F.col("f.seq"), F.col("f.pos"))
    timed = F.min(F.when(F.col("timestamp") > 0, F.struct("seq", "pos", "timestamp"))).alias("t")
    each = _by_description(records, key, timed, F.count("*").alias("n"), among=("entity_type", "file_path"))
    each = each.groupBy(*key, "description").agg(F.min("f").alias("f"), F.min("t").alias("t"), _together("s"), F.collect_list(F.struct(*place, "file_path")).alias("p"), F.collect_list(F.when(F.col("entity_type").isNotNull(), F.struct(*place, "n", "entity_type"))).alias("kinds"))
    lists = each.groupBy(*key).agg(F.min("t").alias("t"), _together("s"), _together("p"), _together("kinds"), _descriptions())
    was = stored.select("entity_name", F.col("entity_type").alias("k0"), F.col("description").alias("d0"), F.col("source_id").alias("s0"), F.col("file_path").alias("p0"), F.col("created_at").alias("c0"))
    joined = lists.withColumns({"sources": _in_place("s", "source_id"), "paths": _in_place("p", "file_path")}).join(was, "entity_name", "left")
    kind = F.struct(F.lit(1 << 62).alias("seq"), F.lit(0).alias("pos"), F.lit(1).cast("long").alias("n"), F.col("k0").alias("entity_type"))
    kinds = F.transform("kinds", lambda k: F.struct(k["seq"].cast("long").alias("seq"), k["pos"].cast("int").alias("pos"), k["n"], k["entity_type"]))
    joined = joined.withColumn("kinds", F.when(F.col("k0").isNotNull(), F.concat(kinds, F.array(kind))).otherwise(kinds)).withColumn("entity_type", _most_frequent(F.col("kinds"))).where("entity_type IS NOT NULL")
    fragments = _combined(F.col("d0"), F.col("new_descriptions"))
    joined = joined.withColumn("fragments", fragments).withColumn("fragments", F.when(F.size("fragments") > 0, F.col("fragments")).otherwise(F.array(F.concat(F.lit("Entity "), "entity_name"))))
    paths = F.array_distinct(F.filter(F.concat(_split(F.col("p0")), "paths"), lambda x: x != ""))
    return joined.select(
        "entity_name", "entity_type", F.array_join("fragments", X.SEP).alias("description"), F.array_join(F.array_distinct(F.concat("sources", _split(F.col("s0")))), X.SEP).alias("source_id"),
        F.when(F.size(paths) > 0, F.array_join(paths, X.SEP)).otherwise(F.lit(X.UNKNOWN_SOURCE)).alias("file_path"), F.coalesce("t.timestamp", "c0", F.lit(0)).cast("long").alias("created_at"), F.size("fragments").alias("n_fragments"),
    )


def merge_relations(records: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each relation with records, as it is stored next.

    stored: (src, tgt, weight, source_id, description, keywords).  New weights
    count if their source isn't stored; a relation weighs its sources at least.
    """
    keys = ["src", "tgt"]
    was = stored.select(*keys, F.col("weight").alias("w0"), F.col("source_id").alias("s0"), F.col("description").alias("d0"), F.col("keywords").alias("k0"))
    each = _by_description(records, keys, F.collect_set("keywords").alias("words"))
    lists = each.groupBy(*keys).agg(_together("s"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.min("f.seq").alias("order"), _descriptions())
    joined = lists.withColumn("sources", _in_place("s", "source_id")).join(was, keys, "left").withColumn("w", _new_weight("s", _split(F.col("s0"))))
    sources = F.array_distinct(F.concat("sources", _split(F.col("s0"))))
    words = F.filter(F.transform(F.flatten(F.transform(F.concat("words", F.array(F.coalesce("k0", F.lit("")))), lambda k: F.split(k, ","))), lambda k: F.trim(k)), lambda k: k != "")
    return joined.select(*keys, F.greatest(F.coalesce("w0", F.lit(0.0)) + F.col("w"), F.size(sources).cast("double")).alias("weight"), F.array_join(F.array_sort(F.array_distinct(words)), ", ").alias("keywords"), F.array_join(_combined(F.col("d0"), F.col("new_descriptions")), X.SEP).alias("description"), F.array_join(sources, X.SEP).alias("source_id"), "order")


def tracked(existing: Column, incoming: Column, limit: int, keep_first: bool = True) -> Column:
    """Both lists in order without repeats, cut to the limit: the first ones are kept, or the last."""
    both = F.array_distinct(F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(incoming, F.array().cast("array<string>"))))
    return F.slice(both, 1, limit) if keep_first else F.slice(both, F.greatest(F.size(both) - limit + 1, F.lit(1)), F.lit(limit))


def tracking(rows: DataFrame, stored: DataFrame, keys: list[str], limit: int, keep_first: bool = True) -> DataFrame:
    """Tracking lists (keys, chunks) that change: stored ones and the rows' (keys, source_id, seq, pos) sources."""
    new = rows.groupBy(*keys).agg(_in_order("source_id", "seq", "pos").alias("incoming"))
    joined = new.join(stored.select(*keys, F.col("chunks").alias("existing")), keys, "left")
    return joined.select(*keys, tracked(F.col("existing"), F.col("incoming"), limit, keep_first).alias("chunks"), "existing").where(~F.col("existing").eqNullSafe(F.col("chunks"))).drop("existing")


def anchors(entities: DataFrame, relations: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """(doc_id, entities, relations): the sorted names and keys that each document's chunks (chunk_id, doc_id) gave."""
    of = chunk_docs.select(F.col("chunk_id").alias("source_id"), "doc_id")
    e = entities.join(of, "source_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("entity_name")).alias("entities"))
    r = relations.join(of, "source_id").groupBy("doc_id").agg(F.array_sort(F.collect_set(X.relation_key(F.col("src"), F.col("tgt")))).alias("relations"))
    none = F.array().cast("array<string>")
    return e.join(r, "doc_id", "full").select("doc_id", F.coalesce("entities", none).alias("entities"), F.coalesce("relations", none).alias("relations"))


def entity_vectors(merged: DataFrame) -> DataFrame:
    """Rows of the entity index: id, content and name."""
    return merged.select(X.vector_id("ent-", F.col("entity_name")).alias("id"), F.concat_ws("\n", "entity_name", "description").alias("content"), "entity_name")


def relation_vectors(merged: DataFrame) -> DataFrame:
    """Rows of the relation index; ids of both directions stand for one relation."""
    ids = F.array(X.vector_id("rel-", F.col("src"), F.col("tgt")), X.vector_id("rel-", F.col("tgt"), F.col("src")))
    return merged.select(ids.alias("ids"), F.concat_ws("\n", F.concat_ws("\t", "keywords", "src"), "tgt", "description").alias("content"), "src", "tgt")


def batches(fragments: DataFrame, key: str, order: str, tokens: str, limit: int = SUMMARY_CONTEXT) -> DataFrame:
    """fragments with batch: each key's fragments in order, a new batch where the next one would pass the limit."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.aggregate(F.collect_list(tokens).over(w), F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used")), lambda s, t: F.when((s["used"] > 0) & (s["used"] + t > limit), F.struct((s["batch"] + 1).alias("batch"), t.cast("long").alias("used"))).otherwise(F.struct(s["batch"].alias("batch"), (s["used"] + t).cast("long").alias("used"))))
    return fragments.withColumn("batch", step["batch"])


def remaining_sources(tracking: Column, graph: Column, deleted: Column) -> Column:
    return F.array_except(F.array_union(F.coalesce(tracking, F.array().cast("array<string>")), F.coalesce(graph, F.array().cast("array<string>"))), deleted)


def purge(stored: DataFrame, tracking_rows: DataFrame, records: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities without deleted chunks (chunk_id): those that stay as they are, those rebuilt from what is left, and the names that go.

    tracking_rows: (entity_name, chunks); records: all cached entity records.
    Only entities that a deleted chunk gave are touched.
    """
    gone = deleted.select(F.col("chunk_id").alias("source_id")).distinct()
    sources = stored.select("entity_name", F.explode(_split(F.col("source_id"))).alias("source_id")).unionByName(tracking_rows.select("entity_name", F.explode("chunks").alias("source_id"))).distinct()
    hit = sources.join(gone, "source_id", "left_semi").select("entity_name").distinct()
    left = sources.join(hit, "entity_name", "left_semi").join(gone, "source_id", "left_anti")
    alive = left.select("entity_name").distinct()
    rebuilt = merge_entities(records.join(left, ["entity_name", "source_id"], "left_semi"), stored.limit(0))
    return stored.join(hit, "entity_name", "left_anti"), rebuilt, hit.join(alive, "entity_name", "left_anti")


def dangling(stored: DataFrame, tracking_rows: DataFrame) -> DataFrame:
    """Entities that neither name a source nor are tracked."""
    kept = tracking_rows.where(F.size("chunks") > 0).select("entity_name")
    return stored.where(F.size(_split(F.col("source_id"))) == 0).join(kept, "entity_name", "left_anti").select("entity_name")


def unreferenced(cache: DataFrame, chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """The call cache (key, ...) without rows that deleted chunks alone refer to; chunks: (chunk_id, cache_keys)."""
    refs = chunks.select("chunk_id", F.explode("cache_keys").alias("key"))
    gone = refs.join(deleted.select("chunk_id"), "chunk_id", "left_semi").select("key").distinct()
    kept = refs.join(deleted.select("chunk_id"), "chunk_id", "left_anti").select("key").distinct()
    return cache.join(gone.join(kept, "key", "left_anti"), "key", "left_anti")
