"""The bitemporal fact store as pure DataFrame operations: each takes the current tables and gives the next ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scope import is_current


def put(store: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of batch replace those of store with equal keys; of equal keys in batch the one last by order stays."""
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("__r")).select("__r.*").select(*store.columns)
    return store.join(last.select(*keys), keys, "left_anti").unionByName(last)


def remove(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return store.join(keys.select(*on).distinct(), on, "left_anti")


def multi_get(store: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Every wanted row, at its place, with the store's columns, null where the key is missing."""
    return wanted.join(store, key, "left")


def supersede(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (old_id, new_id, at).  An old fact that is still open is closed at that time and points to the new one."""
    p = pairs.groupBy("old_id").agg(F.min(F.struct("at", "new_id")).alias("p"))
    j = store.join(p, store["id"] == F.col("old_id"), "left")
    hit = F.col("p").isNotNull() & F.col("superseded_by").isNull()
    new = {"superseded_by": F.col("p.new_id"), "valid_to": F.col("p.at"), "revision": F.col("revision") + 1}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in store.columns])


def text_key() -> Column:
    """The hash that a rejected text is remembered by: its scope and its folded, lower-cased text."""
    return F.md5(F.concat_ws("\u0001", F.col("ws"), F.col("sess"), F.col("task"), F.lower(F.regexp_replace(F.col("text"), r"\s+", " "))))


def reject(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with the facts of ids rejected, and the tombstones of their texts."""
    bad = ids.select("id").distinct().withColumn("__bad", F.lit(True))
    j = store.join(bad, "id", "left")
    out = j.select(*[F.when(F.col("__bad"), "Rejected").otherwise(F.col(c)).alias(c) if c == "trust_state" else F.when(F.col("__bad"), F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "revision" else F.col(c) for c in store.columns])
    return out, store.join(bad, "id", "left_semi").select(text_key().alias("tombstone")).distinct()


def screen(batch: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Facts whose text wasn't rejected in their scope."""
    return batch.withColumn("tombstone", text_key()).join(tombstones, "tombstone", "left_anti").drop("tombstone")


def invalidate(store: DataFrame, events: DataFrame, at: int) -> DataFrame:
    """Current facts that cite one of the events (session_id, event_id) end at that time and are revised."""
    cited = store.where(is_current()).select("id", F.explode("source_refs").alias("r"))
    hit = cited.join(events, (F.col("r.session_id") == events["session_id"]) & (F.col("r.event_id") == events["event_id"]), "left_semi").select("id").distinct().withColumn("__hit", F.lit(True))
    new = {"valid_to": F.lit(at), "revision": F.col("revision") + 1}
    return store.join(hit, "id", "left").select(*[F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in store.columns])


def corroborate(store: DataFrame, refs: DataFrame, sessions: int = 2) -> DataFrame:
    """refs: (id, session_id, event_id).  New references are added once; a fact known from enough sessions becomes Corroborated."""
    add = refs.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("session_id", "event_id"))).alias("__add"))
    j = store.join(add, "id", "left")
    merged = F.array_union("source_refs", F.coalesce("__add", F.array().cast("array<struct<session_id:string,event_id:string>>")))
    enough = F.size(F.array_distinct(F.transform(merged, lambda r: r["session_id"]))) >= sessions
    promote = F.col("__add").isNotNull() & enough & (F.col("trust_state") == "Trusted")
    return j.select(*[merged.alias(c) if c == "source_refs" else F.when(promote, "Corroborated").otherwise(F.col(c)).alias(c) if c == "trust_state" else F.col(c) for c in store.columns])


def cascade_sources(elements: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """elements: (element, chunk_id), one row for each source.  The rows that stay, and elements left without any source."""
    left = elements.join(deleted.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return left, elements.select("element").distinct().join(left.select("element").distinct(), "element", "left_anti")


def pending(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Turns after their conversation's mark (conversation_id, last_turn_id, last_timestamp): not the marked one and later than it."""
    j = turns.join(marks, "conversation_id", "left")
    covered = (F.col("turn_id") == F.col("last_turn_id")) | (F.col("timestamp") <= F.col("last_timestamp"))
    return j.where(~F.coalesce(covered, F.lit(False))).select(*turns.columns)


def advance(marks: DataFrame, turns: DataFrame) -> DataFrame:
    """Marks moved to the latest turn; a mark never moves back."""
    new = turns.groupBy("conversation_id").agg(F.max_by("turn_id", "timestamp").alias("last_turn_id"), F.max("timestamp").alias("last_timestamp"))
    both = marks.unionByName(new)
    return both.groupBy("conversation_id").agg(F.max_by("last_turn_id", "last_timestamp").alias("last_turn_id"), F.max("last_timestamp").alias("last_timestamp"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replace_facts(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with new facts (its columns and supersedes) in, and those that they supersede closed at the new fact's time, in one table."""
    pairs = new.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("old_id"), F.col("id").alias("new_id"), F.col("created_at").alias("at"))
    return supersede(store, pairs).join(new.select("id"), "id", "left_anti").select(*store.columns).unionByName(new.select(*store.columns))


def slots(stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """(ws, slot, action) of an index run that may be done again: unchanged where the content hash is the same, supersede where it differs, fresh where the slot is new, gone where the corpus lost it."""
    keys = ["ws", "slot"]
    j = stored.select(*keys, F.col("content_hash").alias("h0")).join(corpus.select(*keys, F.col("content_hash").alias("h1")), keys, "full")
    return j.select(*keys, F.when(F.col("h0").isNull(), "fresh").when(F.col("h1").isNull(), "gone").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("supersede").alias("action"))
