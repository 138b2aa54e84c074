"""Communities of a graph in levels, their tables, reports and what a report reads.

Nodes join the neighbouring community that gains most modularity, in rounds
of joins, each round settled by a salted hash of the community so that two
nodes don't chase each other; communities become the nodes of the next level.
A community larger than the limit is divided again, from its own edges.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as X
from .graph import _saved

#: Largest community, rounds of a level, and levels; fixed values.
MOST, ROUNDS, LEVELS, SEED = 10, 8, 6, 0xDEADBEEF


def _settled(edges: DataFrame, labels: DataFrame, degree: DataFrame, total: float, round_: int, most: int) -> DataFrame:
    """One round: the label of each node after the best move, of nodes whose turn it is."""
    sums = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("s"), F.count("*").alias("size"))
    near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
    own = labels.select("node", F.col("label").alias("mine")).join(degree, "node")
    options = near.join(own, "node").join(sums, "label")
    inside = F.col("label") == F.col("mine")
    gain = F.col("w") - F.col("k") * (F.col("s") - F.when(inside, F.col("k")).otherwise(0.0)) / F.lit(total)
    fits = inside | (F.col("size") < most)
    best = options.where(fits).groupBy("node").agg(F.max_by("label", F.struct(F.round(gain, 9).alias("g"), inside.cast("int").alias("stay"), F.hash("label").alias("h"))).alias("best"), F.max(F.when(inside, F.round(gain, 9))).alias("now"), F.max(F.round(gain, 9)).alias("top"))
    turn = F.pmod(F.xxhash64("node", F.lit(SEED + round_)), F.lit(2)) == 0
    return labels.join(best, "node", "left").select("node", F.when(turn & F.col("best").isNotNull() & (F.col("top") > F.greatest(F.coalesce("now", F.lit(0.0)), F.lit(0.0))), F.col("best")).otherwise(F.col("label")).alias("label"))


def partition(edges: DataFrame, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(node, label) of undirected edges (src, tgt, weight): label is a node of the community, none larger than most."""
    both = _saved(edges.where("src <> tgt").select(F.col("src").alias("node"), F.col("tgt").alias("other"), "weight").unionByName(edges.where("src <> tgt").select(F.col("tgt").alias("node"), F.col("src").alias("other"), "weight")))
    degree = _saved(both.groupBy("node").agg(F.sum("weight").cast("double").alias("k")))
    total = float(degree.agg(F.sum("k")).first()[0] or 0)
    labels = _saved(degree.select("node", F.col("node").alias("label")))
    for round_ in range(rounds if total else 0):
        labels = _saved(_settled(both, labels, degree, total, round_, most))
    return capped(connected(both, labels), most)


def connected(both: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with parts of a community that no inner edge joins set apart; each part is named by its least node."""
    from .graph import components

    l2 = labels.select(F.col("node").alias("other"), F.col("label").alias("l2"))
    inner = both.join(labels, "node").join(l2, "other").where("label = l2").select(F.col("node").alias("src"), F.col("other").alias("tgt"))
    parts = components(inner)
    return labels.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def capped(labels: DataFrame, most: int) -> DataFrame:
    """labels with communities beyond the limit, which rounds at one time can make, cut in order of their nodes."""
    w = Window.partitionBy("label").orderBy("node")
    part = F.floor((F.row_number().over(w) - 1) / most)
    cut = labels.withColumn("part", part)
    first = F.min("node").over(Window.partitionBy("label", "part"))
    return cut.select("node", first.alias("label"))


def hierarchy(edges: DataFrame, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """(node, level, cluster): the communities of each level, level 0 the coarsest, numbered level by level in order of their least node.

    A coarser community is made of finer ones joined by the edges between
    them.  Edges (src, tgt, weight) are taken without direction.
    """
    labels = _saved(partition(edges, most))
    found = [labels]
    coarse = labels
    for _ in range(levels - 1):
        a = coarse.select(F.col("node").alias("src"), F.col("label").alias("a"))
        b = coarse.select(F.col("node").alias("tgt"), F.col("label").alias("b"))
        above = edges.join(a, "src").join(b, "tgt").where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")).agg(F.sum("weight").alias("weight"))
        above = _saved(above)
        if above.isEmpty():
            break
        up = _saved(partition(above, most)).select(F.col("node").alias("label"), F.col("label").alias("up"))
        grown = _saved(coarse.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        if grown.select("label").distinct().count() == coarse.select("label").distinct().count():
            break
        found.append(grown)
        coarse = grown
    out = None
    for level, rows in enumerate(reversed(found)):
        one = rows.select("node", F.lit(level).alias("level"), "label")
        out = one if out is None else out.unionByName(one)
    numbers = out.groupBy("level", "label").agg(F.min("node").alias("first"))
    numbers = numbers.withColumn("cluster", (F.row_number().over(Window.orderBy("level", "first")) - 1).cast("long"))
    return out.join(numbers.drop("first"), ["level", "label"]).select("node", "level", "cluster")


def schema(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each cluster: level, sorted nodes, edges at its nodes, chunks of both, occurrence (its chunks before repeats go, relative to the most), and its sub-communities.

    nodes (node, source_id), edges (src, tgt, source_id); sources are joined ids.
    """
    rows = members.join(nodes, "node", "left")
    ids = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), X.SEP), lambda x: x != "")
    at = members.select(F.col("node").alias("src"), "level", "cluster").join(edges, "src").unionByName(members.select(F.col("node").alias("tgt"), "level", "cluster").join(edges, "tgt"))
    pair = at.select("level", "cluster", F.struct(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).alias("e"), "source_id")
    own = rows.groupBy("level", "cluster").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.flatten(F.collect_list(ids(F.col("source_id")))).alias("c1"))
    of_edges = pair.groupBy("level", "cluster").agg(F.array_sort(F.collect_set("e")).alias("edges"), F.flatten(F.collect_list(ids(F.col("source_id")))).alias("c2"))
    both = own.join(of_edges, ["level", "cluster"], "left").withColumn("all", F.concat("c1", F.coalesce("c2", F.array().cast("array<string>"))))
    top = F.max(F.size("all")).over(Window.partitionBy(F.lit(1)))
    out = both.select("level", "cluster", "nodes", F.coalesce("edges", F.array().cast("array<struct<a:string,b:string>>")).alias("edges"), F.array_sort(F.array_distinct("all")).alias("chunks"), F.when(top > 0, F.size(F.array_distinct("all")) / top).otherwise(0.0).alias("occurrence"))
    return out.join(children(members), ["level", "cluster"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<long>")))


def children(members: DataFrame) -> DataFrame:
    """(level, cluster, children): clusters of the next level whose nodes all lie in it."""
    size = members.groupBy("level", "cluster").agg(F.count("*").alias("n")).select((F.col("level") - 1).alias("level"), F.col("cluster").alias("child"), "n")
    low = members.select("node", (F.col("level") - 1).alias("level"), F.col("cluster").alias("child"))
    both = members.join(low, ["node", "level"]).groupBy("level", "cluster", "child").agg(F.count("*").alias("c"))
    return both.join(size, ["level", "child"]).where("c = n").groupBy("level", "cluster").agg(F.array_sort(F.collect_list("child")).alias("children"))


def uncovered(rows: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Node or edge rows that no sub-community's report holds."""
    return rows.join(covered.select(*keys).distinct(), keys, "left_anti")


def packed(rows: DataFrame, budget: int, tokens: Column, degree: str = "degree") -> DataFrame:
    """Rows of a description (cluster, kind, line, degree, idx) by falling degree while their tokens fit the kind's share of the budget, which follows the numbers of node and edge rows."""
    counts = Window.partitionBy("cluster")
    share = F.count("*").over(Window.partitionBy("cluster", "kind")) / F.count("*").over(counts)
    ordered = Window.partitionBy("cluster", "kind").orderBy(F.desc(degree), "idx").rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("share", share).withColumn("used", F.sum(tokens + 1).over(ordered))
    return used.where(F.col("used") <= F.floor(F.col("share") * budget)).drop("used", "share")


def description(rows: DataFrame) -> DataFrame:
    """(cluster, text): node lines, then edge lines, in order of degree."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.desc_nulls_last("kind") if False else F.when(F.col("kind") == "node", 0).otherwise(1).alias("k"), (-F.col("degree")).alias("d"), "idx", "line"))), lambda x: x["line"])
    return rows.groupBy("cluster").agg(F.array_join(lines, "\n").alias("text"))


def report_markdown(report: str) -> str:
    """A report in JSON (title, summary, findings) as Markdown; text that isn't one gives the empty string."""
    try:
        data = json.loads(report)
    except ValueError:
        return ""
    if not isinstance(data, dict):
        return ""
    parts = []
    for x in data.get("findings") or []:
        parts.append(f"## {x}\n\n" if isinstance(x, str) else f"## {x.get('summary', '')}\n\n{x.get('explanation', '')}")
    return f"# {data.get('title', 'Report')}\n\n{data.get('summary', '')}\n\n" + "\n\n".join(parts)


def rating(report: str) -> float:
    try:
        return float(json.loads(report).get("rating", 0))
    except (ValueError, TypeError, AttributeError):
        return 0.0


def in_report_order(clusters: DataFrame) -> list[DataFrame]:
    """Clusters level by level, the finest first, so that a report can read those of its sub-communities; levels are few."""
    levels = sorted((r["level"] for r in clusters.select("level").distinct().collect()), reverse=True)
    return [clusters.where(F.col("level") == x).orderBy("cluster") for x in levels]
