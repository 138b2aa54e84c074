"""Recall over facts: a scoped vector arm, a BM25 arm, a graph arm and a temporal order, fused and read back from the store.

Facts are (id, ws, sess, task, text, created_at, ...); vectors (id, ws, sess,
task, vector).  Every arm is cut to its top k before it is ranked, and its
scope filter stands below the ranking, where it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import text as T
from . import retrieval as R

#: Okapi parameters.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Options:
    """Knobs of a recall; the values are fixed defaults."""

    top_k: int = 40
    arm_limit: int = 250
    seeds: int = 10
    hops: int = 2
    constant: int = 60
    summary_chars: int = 200
    near_zero: float = 0.05
    corrects: float = 1.5
    derived: float = 1.2
    max_age: int | None = None
    min_sessions: int = 2
    now: int = 0
    since: int | None = None
    until: int | None = None
    arms: tuple[str, ...] = ("vector", "lexical", "graph")


@dataclass
class Outcome:
    """Hits (id, score, via, rank, summary and the fact's columns), and the arms that failed with their errors."""

    hits: DataFrame
    degraded: dict[str, str] = field(default_factory=dict)


def vector_arm(vectors: DataFrame, query: list[float], k: int, ws: str, sess: str | None = None, task: str | None = None) -> DataFrame:
    """The k nearest vectors that the scope admits, by falling cosine, ties by id; k = 0 gives none, another length is an error."""
    scoped = vectors.where(S.admits(ws, sess, task))
    q = F.array(*[F.lit(float(x)) for x in query])
    same = F.when(F.size("vector") != len(query), F.raise_error(F.lit("the query has another dimension"))).otherwise(F.lit(True))
    return R.ranked(scoped.where(same.cast("boolean")).select("id", T.cosine(F.col("vector"), q).alias("score")), k)


def bm25(facts: DataFrame, query: str, k: int) -> DataFrame:
    """Facts that have every token of the query, by their Okapi score, ties by id; a query without tokens finds none.

    The corpus statistics are of the facts given, so the caller scopes them first.
    """
    wanted = list(dict.fromkeys(T_python_tokens(query)))
    rows = facts.select("id", T.tokens(F.col("text")).alias("t"))
    if not wanted:
        return R.ranked(rows.select("id", F.lit(None).cast("double").alias("score")), k)
    has = [F.array_contains("t", w) for w in wanted]
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("length"), *[F.sum(h.cast("long")).alias(f"df{i}") for i, h in enumerate(has)])
    every = has[0]
    for h in has[1:]:
        every = every & h
    joined = rows.where(every).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        tf = F.size(F.filter("t", (lambda w: lambda x: x == w)(w)))
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("t") / F.col("length")))
    return R.ranked(joined.select("id", score.alias("score")), k)


def T_python_tokens(text: str) -> list[str]:  # noqa: N802
    """The same tokens as those of the column function, of a query text."""
    import re

    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def graph_arm(edges: DataFrame, seeds: DataFrame, options: Options) -> DataFrame:
    """Facts around the seeds (id) by the weights of the edges between them."""
    near = R.hops(edges, seeds, options.hops)
    return R.ranked(R.graph_scores(edges, near, options.corrects, options.derived), options.arm_limit)


def edges_of(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges (src, dst, rel, weight) that a walk of depth hops from the seeds meets, each once: those with an end within depth - 1."""
    inner = R.hops(edges, seeds, depth - 1).select("id") if depth > 1 else seeds.select("id").distinct()
    out = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return out.dropDuplicates(["src", "dst", "rel"])


def by_kind(edges: DataFrame, rel: str, ws: str, sess: str | None = None) -> DataFrame:
    return edges.where((F.col("rel") == rel) & S.admits(ws, sess)).orderBy("src", "dst", "rel")


#: First date in a text, and words that name a day relative to now, in English and Chinese; fixed values.
_DATE = r"(?<![0-9])([12][0-9]{3})[-/.年]([01]?[0-9])[-/.月]([0-3]?[0-9])(?![0-9])"
RELATIVE = (("day before yesterday", -2), ("yesterday", -1), ("today", 0), ("tomorrow", 1), ("last week", -7), ("last month", -30), ("前天", -2), ("昨天", -1), ("今天", 0), ("明天", 1), ("上周", -7), ("上个月", -30))
DAY_MS = 86_400_000


def temporal_centre(query: str, now_ms: int) -> int | None:
    """UTC midnight, in milliseconds, of the first date or relative day that the query names."""
    import datetime
    import re

    found: list[tuple[int, int]] = []
    for m in re.finditer(_DATE, query):
        try:
            found.append((m.start(), (datetime.date(*map(int, m.groups())) - datetime.date(1970, 1, 1)).days))
            break
        except ValueError:
            continue
    low = query.lower()
    for word, days in RELATIVE:
        at = low.find(word)
        if at >= 0:
            found.append((at, now_ms // DAY_MS + days))
    return min(found)[1] * DAY_MS if found else None


def by_nearness(hits: DataFrame, time: str, centre: int | None) -> DataFrame:
    """hits with rank again by distance in time from the centre, ties as before; without a centre as they are."""
    if centre is None:
        return hits
    order = Window.orderBy(F.abs(F.col(time) - centre), "rank")
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))


def judged(hits: DataFrame, relevance: Column, near_zero: float) -> DataFrame:
    """hits by falling relevance, ties as before; none at all if no relevance is above near zero."""
    scored = hits.withColumn("relevance", relevance)
    top = F.max("relevance").over(Window.partitionBy(F.lit(1)))
    kept = scored.withColumn("__top", top).where(F.col("__top") > near_zero).drop("__top")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), "rank")).cast("long"))


def _try(name: str, build: Callable[[], DataFrame], degraded: dict[str, str]) -> DataFrame | None:
    """An arm's plan, analysed; an arm that can't be planned degrades the recall and doesn't fail it."""
    try:
        arm = build()
        arm.schema  # noqa: B018
        return arm
    except Exception as error:  # noqa: BLE001
        degraded[name] = str(error).split("\n")[0]
        return None


def recall(facts: DataFrame, vectors: DataFrame | None, edges: DataFrame | None, query: str, vector: list[float] | None, options: Options, ws: str, sess: str | None = None, task: str | None = None) -> Outcome:
    """The best facts of a scope for a query, from all arms.

    The vector and lexical arms rank what the scope admits; the best of each
    seed the graph arm.  Ranks are fused by reciprocals, the facts read back
    in the scope, those that aren't current, are stale or outside the time
    window dropped, and a date in the query orders the rest by nearness.
    """
    scoped = facts.where(S.admits(ws, sess, task))
    degraded: dict[str, str] = {}
    arms: dict[str, DataFrame] = {}
    if "vector" in options.arms and vectors is not None and vector:
        if (arm := _try("vector", lambda: vector_arm(vectors, vector, options.arm_limit, ws, sess, task), degraded)) is not None:
            arms["vector"] = arm
    if "lexical" in options.arms and (arm := _try("lexical", lambda: bm25(scoped, query, options.arm_limit), degraded)) is not None:
        arms["lexical"] = arm
    if "graph" in options.arms and edges is not None and arms:
        seeds = None
        for arm in arms.values():
            own = arm.where(F.col("rank") <= options.seeds).select("id")
            seeds = own if seeds is None else seeds.union(own)
        if (arm := _try("graph", lambda: graph_arm(edges.where(S.admits(ws, sess)), seeds, options), degraded)) is not None:
            arms["graph"] = arm
    if not arms:
        return Outcome(scoped.select("*", F.lit(0.0).alias("score"), F.lit("").alias("via"), F.lit(0).cast("long").alias("rank")).limit(0), degraded)
    fused = R.fuse(arms, options.arm_limit, options.constant)
    live = scoped.where(S.is_current() & S.in_window(F.col("created_at"), options.since, options.until))
    if options.max_age is not None:
        live = live.where(~S.stale(options.now, options.max_age, options.min_sessions))
    hits = fused.join(live, "id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
    hits = by_nearness(hits, "created_at", temporal_centre(query, options.now)).where(F.col("rank") <= options.top_k)
    return Outcome(hits.withColumn("summary", T.summary(F.col("text"), options.summary_chars)), degraded)


def of_kind(facts: DataFrame, kind: str, ws: str, sess: str | None = None) -> DataFrame:
    """Facts of a kind in a scope that nothing supersedes, by id."""
    return facts.where((F.col("kind") == kind) & S.admits(ws, sess) & F.col("superseded_by").isNull()).orderBy("id")


def derivations(edges: DataFrame, ws: str, sess: str | None = None) -> DataFrame:
    """Edges from rules to episodes and from procedures to rules, in order."""
    return edges.where(F.col("rel").isin("DependsOn", "Corrects") & S.admits(ws, sess)).orderBy("src", "dst", "rel")


def relations_of(edges: DataFrame, entity: str, k: int) -> DataFrame:
    """The heaviest edges at an entity, ties by the other end."""
    near = edges.where((F.col("src") == entity) | (F.col("dst") == entity)).withColumn("other", F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src")))
    return near.orderBy(F.desc("weight"), "other", "rel").limit(k)


def timeline(facts: DataFrame, story: str, unit: int | None = None) -> DataFrame:
    """Facts by story number, those without one first, ties by id."""
    out = facts if unit is None else facts.where(F.col(story) == unit)
    return out.orderBy(F.asc_nulls_first(story), "id")


def supply(hits: DataFrame, top_k: int) -> DataFrame:
    """For each arm: hits that it found, those that no other did, and whether it filled the top k."""
    rows = hits.select("id", F.split("via", r"\+").alias("arms"))
    one = rows.select(F.explode("arms").alias("arm"), (F.size("arms") == 1).cast("long").alias("alone"))
    return one.groupBy("arm").agg(F.count("*").alias("candidates"), F.sum("alone").alias("exclusive"), (F.count("*") >= top_k).alias("saturated"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, score double, rank long")
