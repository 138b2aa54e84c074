"""Named tables of a workspace: keyed values, vectors, facts, graph and pending writes, as Parquet below one folder.

A write makes the next version of a table and then names it in the table's
own log, so readers see the old rows or the new ones whole, and a write that
dies leaves the old version in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope as S
from ..operators import facts as O

SCHEMAS = {
    "kv": "namespace string, key string, value string",
    "vectors": "namespace string, id string, content string, meta string, vector array<float>",
    "fact_vectors": "ws string, sess string, task string, fact_id string, vector array<float>",
    "nodes": "id string, data map<string,string>, seq long",
    "edges": "src string, tgt string, data map<string,string>, seq long",
    "fact_edges": "ws string, sess string, task string, src string, dst string, rel string, weight double, source_event_id string",
    "pending": "target string, name string, payload string, done boolean",
}
KEYS = {"kv": ["namespace", "key"], "vectors": ["namespace", "id"], "fact_vectors": ["ws", "sess", "task", "fact_id"], "nodes": ["id"], "edges": ["src", "tgt"], "fact_edges": ["ws", "sess", "task", "src", "dst", "rel"], "pending": ["target", "name"]}


class Workspace:
    """All tables of one configuration."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, name: str) -> str:
        return f"{self.folder}/{name}/log"

    def _versions(self, name: str) -> list[dict]:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema("number long, version string").json(self._log(name)).orderBy(F.desc("number")).limit(1).collect()
        except AnalysisException:
            return []
        return [r.asDict() for r in rows]

    def read(self, name: str) -> DataFrame:
        """The table's present rows; a table that was never written is empty."""
        last = self._versions(name)
        if not last:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{last[0]['version']}")

    def write(self, name: str, rows: DataFrame) -> None:
        last, version = self._versions(name), uuid.uuid4().hex
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.parquet(f"{self.folder}/{name}/{version}")
        entry = json.dumps({"number": (last[0]["number"] if last else 0) + 1, "version": version})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("append").text(self._log(name))

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> None:
        """Rows in place of those with equal keys; of equal keys in rows the one last by order stays, or any if there is no order."""
        batch = rows.withColumn("__o", F.col(order) if order else F.monotonically_increasing_id())
        store = self.read(name)
        self.write(name, O.put(store, batch.select(*store.columns, "__o"), KEYS[name], "__o"))

    def remove(self, name: str, keys: DataFrame) -> None:
        self.write(name, O.remove(self.read(name), keys, [k for k in KEYS[name] if k in keys.columns]))

    def drop(self, namespace: str, name: str = "kv") -> None:
        self.write(name, self.read(name).where(F.col("namespace") != namespace))

    def keys(self, namespace: str) -> DataFrame:
        return self.read("kv").where(F.col("namespace") == namespace).select("key")

    def get(self, namespace: str, key: str) -> str | None:
        row = self.read("kv").where((F.col("namespace") == namespace) & (F.col("key") == key)).select("value").first()
        return row["value"] if row else None

    def get_many(self, namespace: str, wanted: DataFrame) -> DataFrame:
        """wanted (pos, key) with value, null where the key is missing."""
        own = self.read("kv").where(F.col("namespace") == namespace).select("key", "value")
        return O.multi_get(own, wanted, "key")

    def missing(self, namespace: str, keys: DataFrame) -> DataFrame:
        return keys.join(self.keys(namespace), "key", "left_anti")

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges in the order in which they came (seq)."""
        return self.read("nodes").orderBy("seq"), self.read("edges").orderBy("seq")


def merged_attributes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (keys, data, seq): attributes of new over those of old, the place of the old row."""
    o = old.select(*keys, F.col("data").alias("d0"), F.col("seq").alias("s0"))
    n = new.groupBy(*keys).agg(F.max_by("data", "seq").alias("d1"), F.min("seq").alias("s1"))
    none = F.create_map().cast("map<string,string>")
    d0, d1 = F.coalesce("d0", none), F.coalesce("d1", none)
    data = F.map_concat(F.map_filter(d0, lambda k, _: ~F.array_contains(F.map_keys(d1), k)), d1)
    return o.join(n, keys, "full").select(*keys, data.alias("data"), F.coalesce("s0", "s1").alias("seq"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes (id) and every edge at them, whichever way it points."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("tgt")), "tgt", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select(*edges.columns)


def incident(edges: DataFrame, node: str) -> DataFrame:
    """(node, other, seq) of the edges at a node: outgoing first, then incoming, each in order; a loop counts once."""
    out = edges.where(F.col("src") == node).select(F.col("src").alias("node"), F.col("tgt").alias("other"), F.lit(0).alias("way"), "seq")
    back = edges.where((F.col("tgt") == node) & (F.col("src") != node)).select(F.col("tgt").alias("node"), F.col("src").alias("other"), F.lit(1).alias("way"), "seq")
    return out.unionByName(back).orderBy("way", "seq")


def has(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with present: whether rows have its keys."""
    return wanted.join(rows.select(*keys).distinct().withColumn("__p", F.lit(True)), keys, "left").select(*wanted.columns, F.coalesce("__p", F.lit(False)).alias("present"))


def scan(facts: DataFrame, ws: str, sess: str | None = None, task: str | None = None) -> DataFrame:
    """All facts of a scope, superseded ones too, by id."""
    return facts.where(S.admits(ws, sess, task)).orderBy("id")


def record_pending(space: Workspace, rows: DataFrame) -> None:
    """Writes (target, name, payload) that failed and are to be done again."""
    space.upsert("pending", rows.withColumn("done", F.lit(False)))


def replay(space: Workspace, target: str, apply) -> int:
    """Apply the open writes of a target once more and mark them done; returns how many there were."""
    rows = space.read("pending").where((F.col("target") == target) & ~F.col("done"))
    many = rows.count()
    if many:
        apply(rows)
        space.upsert("pending", rows.withColumn("done", F.lit(True)))
    return many
