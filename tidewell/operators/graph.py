"""Property-graph operations on node and edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Edges (src, tgt, weight, seq) by sorted pair; of parallel ones the weight last by seq wins, loops are dropped."""
    pair = edges.where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight", "seq")
    return pair.groupBy("src", "tgt").agg(F.max_by("weight", "seq").alias("weight"))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def edge_degree(edges: DataFrame) -> DataFrame:
    """Each edge with the sum of its ends' degrees."""
    n = degree(edges)
    a, b = n.select(F.col("node").alias("src"), F.col("degree").alias("da")), n.select(F.col("node").alias("tgt"), F.col("degree").alias("db"))
    return edges.join(a, "src").join(b, "tgt").select("src", "tgt", (F.col("da") + F.col("db")).alias("degree"))


def _saved(df: DataFrame) -> DataFrame:
    """df written below the shared checkpoint folder and read again; a folder of this machine serves only a session that runs on it alone.

    checkpoint() would keep the plan's inferred constraints, which double in every round of a loop.
    """
    session, context = df.sparkSession, df.sparkSession.sparkContext
    place = context.getCheckpointDir() or session.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        place = context.getCheckpointDir()
    path = f"{place}/tidewell/{context.applicationId}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (src, tgt) reaches.

    Labels spread along edges and jump through their label's own label, so the
    rounds grow with the logarithm of the longest path.
    """
    both = _saved(edges.select("src", "tgt").union(edges.select("tgt", "src")).toDF("node", "other").distinct())
    labels = _saved(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = low.join(labels.select(F.col("node").alias("low"), F.col("label").alias("far")), "low").select("node", "label", F.least("low", "far").alias("new"))
        jump = _saved(jump)
        if jump.where("label <> new").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = jump.select("node", F.col("new").alias("label"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes, of equals the one with the least node."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(best), "component").select("node", "component", "n")


def merge_entities(records: DataFrame) -> DataFrame:
    """records: (name, type, source_id, seen).  One row for each name: the majority type (ties: first seen), sorted sources, first seen."""
    types = records.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    best = types.groupBy("name").agg(F.min_by("type", F.struct(-F.col("n"), "first")).alias("type"))
    rest = records.groupBy("name").agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.min("seen").alias("created_at"), F.count("*").alias("records"))
    return best.join(rest, "name")


def merge_relations(records: DataFrame, known: DataFrame) -> DataFrame:
    """records, known: (src, tgt, source_id, weight).  Weights of sources that aren't known yet are added to the known ones; a relation weighs its sources at least."""
    new = records.dropDuplicates(["src", "tgt", "source_id"]).join(known.select("src", "tgt", "source_id"), ["src", "tgt", "source_id"], "left_anti")
    both = known.unionByName(new)
    return both.groupBy("src", "tgt").agg(F.greatest(F.sum("weight"), F.count_distinct("source_id").cast("double")).alias("weight"), F.count_distinct("source_id").alias("sources"))
