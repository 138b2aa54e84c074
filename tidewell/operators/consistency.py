"""The relational consistency index: pivots, alignment, drift and conflicts over facts of entities in documents.

Facts are rows (story, entity_id, title, name, doc_type, fact_type, cue, passage_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cues(kind: Column | str, value: Column | str = "cue") -> Column:
    """Distinct cues of one kind, sorted and joined; null if there are none."""
    kept = F.array_sort(F.collect_set(F.when(kind if isinstance(kind, Column) else F.col("fact_type") == kind, F.col(value) if isinstance(value, str) else value)))
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def pivot(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """The cues of each kind side by side for each story and entity."""
    return facts.groupBy("story", "title").agg(*[cues(k).alias(k) for k in kinds])


def tension(facts: DataFrame, left: str, right: str) -> DataFrame:
    """Stories and entities with cues of both kinds."""
    return pivot(facts, [left, right]).where(F.col(left).isNotNull() & F.col(right).isNotNull())


def alignment(facts: DataFrame, plan: str, draft: str) -> DataFrame:
    """For each story how many entities plan and draft have, and which only one has."""
    sides = facts.groupBy("story", "title").agg(F.max((F.col("doc_type") == plan).cast("int")).alias("p"), F.max((F.col("doc_type") == draft).cast("int")).alias("d"))
    only = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("title")))), ",")
    return sides.groupBy("story").agg(F.sum("p").alias("plan_entities"), F.sum("d").alias("draft_entities"), only((F.col("p") == 1) & (F.col("d") == 0)).alias("plan_only"), only((F.col("p") == 0) & (F.col("d") == 1)).alias("draft_only"))


def alias_drift(facts: DataFrame, a: str, b: str) -> DataFrame:
    """Entities that go by different sets of names on two sides, both known."""
    g = facts.groupBy("title").agg(cues(F.col("doc_type") == a, "name").alias("names_a"), cues(F.col("doc_type") == b, "name").alias("names_b"), F.count_distinct(F.when(F.col("doc_type") == a, F.col("name"))).alias("n_a"))
    return g.where(F.col("names_a").isNotNull() & F.col("names_b").isNotNull() & (F.col("names_a") != F.col("names_b")))


def cooccurrence(facts: DataFrame) -> DataFrame:
    """Pairs of entities that share a passage, the lesser title first, with the passages that they share in a story."""
    a = facts.select("story", "passage_id", F.col("title").alias("left")).distinct()
    b = a.select("story", "passage_id", F.col("left").alias("right"))
    return a.join(b, ["story", "passage_id"]).where("left < right").groupBy("story", "left", "right").agg(F.count("*").alias("passages"))


def catalog(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Every entity (entity_id, title) with its mentions, none included, and its names in order."""
    n = facts.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return entities.join(n, "entity_id", "left").select("entity_id", "title", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("names", F.lit("")).alias("names"))


def runs(rows: DataFrame, key: str, order: str, label: str, least: int = 2) -> DataFrame:
    """Runs of equal labels in order within a key, of a least length: start, end, length."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("__new", (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    g = marked.groupBy(key, "__run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return g.where(F.col("length") >= least).drop("__run")
