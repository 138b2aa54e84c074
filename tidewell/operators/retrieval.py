"""Ranked arms and their fusion.

Ranks are only given to rows that a top-k has already cut down, so no sort of a
whole table ends in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
ARMS = ("vector", "lexical", "graph", "temporal")
#: Rows of a part of a group: from the first on there are several parts, and none has more than about the second.
PART_ROWS = (8192, 65536)
#: Rows of a tile of a matrix product, and pairs that are scored at once.
TILE, PAIRS = 2048, 1 << 20


def ranked(rows: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best by falling score, ties by key, with their rank from 1."""
    top = rows.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))


def lexical(facts: DataFrame, query: str, k: int) -> DataFrame:
    """Facts by the share of the query's tokens that they have; those without one aren't ranked."""
    wanted = T.token_set(F.lit(query))
    scored = facts.select("id", T.overlap(wanted, T.token_set(F.col("text"))).alias("score")).where("score > 0")
    return ranked(scored, k)


def all_tokens(facts: DataFrame, tokens: list[str]) -> DataFrame:
    """Facts that have every token, scored by how often they have them."""
    t = T.tokens(F.col("text"))
    rows = facts.select("id", t.alias("t"))
    for x in tokens:
        rows = rows.where(F.array_contains("t", x))
    return rows.select("id", F.size(F.filter("t", lambda x: x.isin(tokens))).alias("score"))


def nearest(vectors: DataFrame, query: DataFrame, k: int, threshold: float = 0.2) -> DataFrame:
    """vectors: (id, vector); query: one row (vector).  The k nearest by cosine at or above the threshold."""
    scored = vectors.select("id", "vector", query.scalar().alias("q")).select("id", T.cosine(F.col("vector"), F.col("q")).alias("score"))
    return ranked(scored.where(F.col("score") >= threshold), k)


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hop) of the nodes within depth undirected hops of the seeds (id), each at its least hop.

    A hop is one join and one minimum over what the hop before gave, which
    stays in as steps of length 0, so the plan grows linearly with depth.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("to"))).distinct()
    reached = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for _ in range(depth):
        steps = reached.join(both, "id", "left").select(F.explode(F.array(F.struct("id", "hop"), F.struct(F.col("to").alias("id"), (F.col("hop") + 1).alias("hop")))).alias("x"))
        reached = steps.where("x.id IS NOT NULL").groupBy("x.id").agg(F.min("x.hop").alias("hop"))
    return reached


def graph_scores(edges: DataFrame, nodes: DataFrame, corrects: float = 1.5, derived: float = 1.2) -> DataFrame:
    """Sum of weight times the kind's factor over the edges between the nodes (id), for both ends."""
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").dropDuplicates(["src", "dst", "rel"])
    w = F.col("weight") * F.when(F.col("rel").isin("Corrects", "Supersedes"), corrects).when(F.col("rel").isin("DependsOn", "AboutTask"), derived).otherwise(1.0)
    return inside.select(F.explode(F.array("src", "dst")).alias("id"), w.alias("w")).groupBy("id").agg(F.sum("w").alias("score"))


def fuse(arms: dict[str, DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked arms (id, rank): id, score and via, the arms that found it in their fixed order."""
    rows = None
    for name, arm in arms.items():
        r = arm.select("id", (1.0 / (constant + F.col("rank"))).alias("s"), F.lit(name).alias("arm"))
        rows = r if rows is None else rows.union(r)
    order = F.array(*[F.lit(a) for a in ARMS])
    fused = rows.groupBy("id").agg(F.sum("s").alias("score"), F.collect_set("arm").alias("arms"))
    return fused.select("id", F.round("score", 9).alias("score"), F.array_join(F.array_intersect(order, "arms"), "+").alias("via")).orderBy(F.desc("score"), "id").limit(k)


def round_robin(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists (id, rank) interleaved, the first list's row first; an id counts at its first place."""
    places = first.select("id", (F.col("rank") * 2).alias("p")).union(second.select("id", (F.col("rank") * 2 + 1).alias("p")))
    return places.groupBy("id").agg(F.min("p").alias("place"))


def _best_of_pair(k: int, threshold: float):
    """Kernel of neighbours over the rows of one pair of parts, or of one part with itself."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        d, a, b = (x.as_py() for x in key[1:])
        ids, flat = pa.concat_arrays(table["id"].chunks), pa.concat_arrays(table["vector"].chunks).flatten().to_numpy(zero_copy_only=False)
        own, vectors = table["part"].to_numpy(), flat.reshape(len(ids), d)
        rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        # from here on rows stand in the order of their ids, so positions break ties
        order = np.argsort(rank, kind="stable")
        order = order[np.isfinite(vectors[order]).all(axis=1)]
        rank, own, n = rank[order], own[order], len(order)
        columns = np.ascontiguousarray(vectors[order].T)
        squares = np.zeros(n)
        for x in columns:
            squares += x.astype(np.float64) ** 2
        norm = np.sqrt(squares)
        unit = np.ascontiguousarray(np.divide(columns, norm, out=np.zeros((d, n)), where=norm > 0).T, dtype=np.float32)
        # twice what a product of single precision may be off by
        slack = (d + 8) * 2.4e-7
        score, at, least = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64), np.full(n, threshold - slack, np.float32)
        repeats = int(np.unique(rank, return_counts=True)[1].max()) if n else 0

        def add(rows, others):
            """Score pairs in double precision, in the order of the elements, and keep the k best of each row."""
            far = rank[rows] != rank[others]
            rows, others = rows[far], others[far]
            s = np.zeros(len(rows))
            for x in columns:
                s += x[rows].astype(np.float64) * x[others]
            size = np.sqrt(squares[rows] * squares[others])
            s = np.clip(np.divide(s, size, out=np.zeros(len(s)), where=size > 0), -1.0, 1.0)
            good = (s >= threshold) & (s >= score[rows, k - 1])
            rows, others, s = rows[good], others[good], s[good]
            touched = np.unique(rows)
            had = at[touched] >= 0
            rows, others, s = np.concatenate([rows, np.repeat(touched, had.sum(axis=1))]), np.concatenate([others, at[touched][had]]), np.concatenate([s, score[touched][had]])
            o = np.lexsort((others, -s, rows))
            rows, others, s = rows[o], others[o], s[o]
            first = np.searchsorted(rows, touched)
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            top = place < k
            score[touched], at[touched] = -np.inf, -1
            score[rows[top], place[top]], at[rows[top], place[top]] = s[top], others[top]
            least[touched] = np.maximum(least[touched], score[touched, k - 1] - slack)

        def one_way(products, rows, others):
            hit = products >= least[rows][:, None]
            take = k + repeats
            if np.count_nonzero(hit) > 16 * take * len(rows) and take < len(others):
                best = np.partition(products, len(others) - take, axis=1)[:, len(others) - take]
                least[rows] = np.maximum(least[rows], best - np.float32(slack))
                hit = products >= least[rows][:, None]
            places = np.flatnonzero(hit)
            for i in range(0, len(places), PAIRS):
                r, c = np.divmod(places[i : i + PAIRS], len(others))
                add(rows[r], others[c])

        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        for i in range(0, len(left), TILE):
            for j in range(i if a == b else 0, len(right), TILE):
                rows, others = left[i : i + TILE], right[j : j + TILE]
                products = unit[rows] @ unit[others].T
                one_way(products, rows, others)
                if a != b or i != j:
                    one_way(np.ascontiguousarray(products.T), others, rows)
        rows, place = np.nonzero(at >= 0)
        ids = ids.take(pa.array(order))
        return pa.table({"id": ids.take(pa.array(rows)), "other": ids.take(pa.array(at[rows, place])), "score": score[rows, place]})

    return run


def neighbours(vectors: DataFrame, group: str, k: int, threshold: float) -> DataFrame:
    """The k most similar other vectors (id, vector) of the same group for each, at or above the threshold.

    All pairs of a group are looked at: ids deal it into parts, and each pair
    of parts is a matrix product in single precision, which only leaves out
    pairs that can't be among the k best; the rest is scored in double
    precision.  A vector without direction scores 0; one with a null, NaN or
    infinite element, and vectors of different lengths, have no score.
    """
    rows = vectors.where(F.col(group).isNotNull() & F.col("id").isNotNull() & F.forall("vector", lambda x: x.isNotNull())).select(group, F.size("vector").alias("d"), "id", "vector")
    # no more rows than parts that are full
    large = rows.groupBy(group, "d").agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS[0])
    parts = F.greatest(F.least(F.ceil(F.col("n") / PART_ROWS[0]), F.lit(8)), F.ceil(F.col("n") / PART_ROWS[1]))
    rows = rows.join(F.broadcast(large), [group, "d"], "left").withColumn("parts", F.when(F.col("n").isNotNull(), parts).otherwise(1).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    met = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.select(group, "d", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part", "id", "vector")
    kind = vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score")).schema
    best = met.groupBy(group, "d", "a", "b").applyInArrow(_best_of_pair(k, threshold), kind)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
