"""Near-duplicate classes from SetSketch registers.

Register i of a set is ``clip(floor(1 - log_b(min_s e_i(s))), 0, q + 1)``
where ``e_i(s)`` is an exponential variate of rate a that a hash of shingle s
gives: an exponentially spaced, truncated minimum.  Registers of a union are
the maxima of the registers, so sketches merge, and equal registers are the
likelier the larger the Jaccard similarity, so bands of them find candidates.
A candidate pair goes on if the joint likelihood of its registers doesn't
exclude the threshold, and is then confirmed on its full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, connected_components, materialize, pieces
from .shingles import U64, mix, shingle_sets

#: Registers of a sketch, registers of a band, and the chance with which a pair just at the threshold may share no band.
REGISTERS, ROWS, MISSED = 128, 4, 1e-5
#: Base, rate and largest exponent of the registers.
BASE, RATE, LIMIT = 1.02, 20.0, 2**15
#: A pair is excluded where its likelihood at the threshold is exp(-SLACK) times the largest or less: about 5 standard deviations.
SLACK = 12.0
#: Buckets with more than so many open comparisons go through the overlap bound first, and rows that have a rare shingle there.
DENSE, RARE = 64, 8
#: Bits of the filter of documents that share a bucket; where it fills up, more sets are written, but none is missed.
FILTER = 1 << 25
_FACTORS = np.random.default_rng(71).integers(0, 2**64, REGISTERS, dtype=U64) | U64(1)


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers, a uint16 row for each set; the empty set has zeros."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    for i in range(REGISTERS):
        least = np.minimum.reduceat(values * _FACTORS[i], offsets[:-1][full])
        wait = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(np.maximum(wait, 1e-300)) / np.log(BASE)) + LIMIT // 2, 0, LIMIT + 1)
    return out


def bands_for(threshold: float) -> int:
    """So many bands that a pair at the threshold shares none with a chance below MISSED: 16 for 0.85, 22 for 0.8."""
    if threshold >= 1:
        return 1
    bands = math.ceil(math.log(MISSED) / math.log1p(-(threshold**ROWS)))
    if bands * ROWS > REGISTERS:
        raise ValueError(f"a similarity of {threshold} needs {bands} bands of {ROWS} registers; a sketch has {REGISTERS}")
    return bands


def merge(*sketches: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets."""
    return np.maximum.reduce(sketches)


def log_likelihood(similarity: np.ndarray, u: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Of the counts of registers where the first set's is above or below the second's; u: the first's share of both cardinalities."""

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - (1 - u) * similarity), p((1 - u) - u * similarity)
    tiny = 1e-12
    return above * np.log(up + tiny) + below * np.log(down + tiny) + (REGISTERS - above - below) * np.log(np.maximum(1 - up - down, tiny))


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood of the registers leaves a similarity of the threshold or more possible."""
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    u = n_a / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.stack([log_likelihood(np.minimum(j, most), u, above, below) for j in np.linspace(0, 1, 41)])
    high = np.stack([log_likelihood(np.minimum(j, most), u, above, below) for j in np.linspace(threshold, 1, 13)])
    return (most >= threshold - 1e-12) & (high.max(0) >= grid.max(0) - SLACK)


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits of each set, from its sorted values."""
    import xxhash

    return [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n, digest, regs) of the (doc_id, text) of docs: size, digest and registers of each shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, offsets = shingle_sets(bytes_of(batch.column("text")), k)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(np.diff(offsets), pa.int64()),
                "digest": pa.array(_digests(values, offsets), pa.binary()), "regs": pa.array([r.tobytes() for r in registers(values, offsets)], pa.binary()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, regs binary")


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each id in a Bloom filter of FILTER bits."""
    h = mix(ids.astype(np.int64).view(U64))
    return (h % U64(FILTER)).astype(np.int64), ((h >> U64(32)) * U64(0x9E3779B1) % U64(FILTER)).astype(np.int64)


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the id of ids: FILTER bits whatever their number, put together by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column("id").to_numpy())))
            word, first = np.unique(at >> 6, return_index=True)
            if len(at):
                yield pa.RecordBatch.from_pydict({"word": word, "bits": np.bitwise_or.reduceat(np.left_shift(U64(1), (at & 63).astype(U64)), first).view(np.int64)})

    rows = ids.select("id").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER >> 6, U64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return out


def shingle_table(docs: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """(id, set): the sorted 64-bit shingle hashes, as bytes, of the texts whose doc_id is among the id of ids, and of a few more.

    A Bloom filter picks the texts where they are read, so no text is
    shuffled; what it picks too much is never asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            a, b = _bits(batch.column("doc_id").to_numpy())
            inside = [(shared.value[x >> 6] >> (x & 63).astype(U64)) & U64(1) for x in (a, b)]
            batch = batch.filter(pa.array((inside[0] & inside[1]).astype(bool)))
            values, offsets = shingle_sets(bytes_of(batch.column("text")), k)
            yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "set": pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "id long, set binary")


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("regs_a", "regs_b")]
                n = [batch.column(x).to_numpy().astype(float) for x in ("n_a", "n_b")]
                yield batch.filter(pa.array(plausible(*regs, *n, threshold))).select(["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            if keep.any():
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _sides(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both rows."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs: doc_id (long), text, more columns.  Documents are linked
    when ``100 * |intersection| >= percent * |union|`` of their distinct
    k-word shingles; component_id is the smallest doc_id reachable.  Null or
    empty texts and texts without words have n_shingles 0 and no links; equal
    texts (ties) are one component under their smallest doc_id; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    Repeated rows of a doc_id are one document and give equal rows; a row
    without doc_id links with nothing, has a null component and is kept.

    Equal sets are folded first.  In each bucket of each band the document
    with the most bucket mates is compared with every other one; then members
    of different components that share a bucket are compared with each other.
    Rows of crowded buckets are compared only with partners of sizes that the
    number of their shingles found elsewhere allows, which loses no link.
    """
    threshold = percent / 100
    sketched = materialize(sketches(docs, k), "sketches")
    classes = sketched.where("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs"))
    classes = materialize(classes.select("id", "n", "digest", "regs"), "classes")
    step = 2 * ROWS
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + step * i, step)) for i in range(bands_for(threshold))]))
    rows = classes.select("id", "n", keys.alias("key"))
    crowd = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    rows = materialize(rows.join(crowd, "key"), "rows")
    score = rows.groupBy("id").agg(F.sum("many").alias("score"))
    scored = rows.join(score, "id")
    heads = scored.groupBy("key").agg(F.min(F.struct(-F.col("score"), "id", "n")).alias("h")).select("key", F.col("h.id").alias("a"), F.col("h.n").alias("n_h"))
    near = (F.col("n") * 100 >= percent * F.col("n_h")) & (F.col("n_h") * 100 >= percent * F.col("n"))
    stars = rows.join(heads, "key").where(near & (F.col("id") != F.col("a"))).select("a", F.col("id").alias("b")).distinct()

    stars = materialize(_likely(_sides(stars, classes, ["n", "regs"]), threshold), "stars")
    sets = materialize(shingle_table(docs, rows, k), "sets")
    links = materialize(_confirmed(_sides(stars, sets, ["set"]), percent), "links")
    parts = connected_components(links)

    rows = rows.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).select("key", "id", "n", "part")
    rows = materialize(rows, "parts")
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("c"), F.min("n").alias("lo"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("all"), F.max(F.struct("c", "part")).alias("top")).where("parts > 1")
    mixed = mixed.select("key", F.col("top.part").alias("most"), ((F.col("all") - F.col("top.c")) * F.col("all") > DENSE).alias("dense"))
    rows = materialize(rows.join(mixed, "key"), "mixed")
    few = rows.where("part <> most")
    other = rows.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("part_b"), "dense")
    ratio = (F.col("n") * 100 >= percent * F.col("n_b")) & (F.col("n_b") * 100 >= percent * F.col("n"))
    open_pair = (F.col("part") != F.col("part_b")) & ratio
    sparse = few.where("not dense").join(other.where("not dense").drop("dense"), "key").where(open_pair).select("id", "b")
    dense = _dense_pairs(few.where("dense"), other.where("dense").drop("dense"), rows.where("dense"), sets, percent, open_pair)
    more = sparse.union(dense).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    more = materialize(_likely(_sides(more, classes, ["n", "regs"]), threshold), "more")
    more = _confirmed(_sides(more, sets, ["set"]), percent)
    parts = connected_components(links.union(more))

    classed = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select("digest", F.col("n").alias("m"), F.coalesce("component", "id").alias("component"))
    joined = sketched.select("doc_id", "n", "digest").join(classed, (sketched.digest == classed.digest) & (sketched.n == F.col("m")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; all columns stay, and all rows of a doc_id stay or go together."""
    verdicts = near_duplicates(docs, percent, k).where(F.col("doc_id").isNotNull())
    gone = verdicts.groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("__kept")).where(~F.col("__kept")).select("__gone")
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def _dense_pairs(few: DataFrame, other: DataFrame, rows: DataFrame, sets: DataFrame, percent: int, open_pair) -> DataFrame:
    """Open pairs of crowded buckets.

    Shingles are rare if RARE rows of crowded buckets or fewer have them.  Two
    rows without a common rare shingle share at most the smaller of their
    numbers o of frequent ones, so they can only be linked if percent * (n + m)
    <= (100 + percent) * o for both; they meet by bucket and size class, which
    that bound limits.  Rows with common rare shingles meet by those, and are
    compared if o and the number of common rare ones together reach the bound.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, packed = batch.column("id").slice(at, 500).to_numpy(), batch.column("set").slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_pydict({"id": np.repeat(ids, [len(x) // 8 for x in packed]), "s": np.frombuffer(b"".join(packed), np.int64)})

    flat = sets.join(rows.select("id").distinct(), "id").select("id", "set").mapInArrow(unpack, "id long, s long")
    shared = materialize(flat.join(flat.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "s"), "shared")
    overlap = materialize(shared.groupBy("id").agg(F.sum((F.col("c") > RARE).cast("int")).alias("o")), "overlap")
    owners = F.array_sort(F.collect_list("id"))
    common = shared.where(F.col("c") <= RARE).groupBy("s").agg(owners.alias("ids")).select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("b")).where("id < b").groupBy("id", "b").agg(F.count("*").alias("rare"))
    about = rows.select("id", "n", "part").distinct().join(overlap, "id")
    common = common.join(about, "id").join(about.select(*[F.col(c).alias(d) for c, d in (("id", "b"), ("n", "n_b"), ("part", "part_b"), ("o", "o_b"))]), "b")
    met = common.where(open_pair & ((F.least("o", "o_b") + F.col("rare")) * (100 + percent) >= percent * (F.col("n") + F.col("n_b")))).select("id", "b")
    fine = 1.02
    size_class = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(fine))).cast("int")
    top = F.least(F.col("n") * 100 / percent, F.col("o") * (100 + percent) / percent - F.col("n")) + 0.5
    low = F.greatest(F.col("n") * percent / 100 - 0.5, F.lit(1.0))
    few = few.select("key", "id", "n", "part").join(overlap, "id").where(top >= low)
    few = few.withColumn("size", F.explode(F.sequence(size_class(low), size_class(top))))
    other = other.join(overlap.select(F.col("id").alias("b"), F.col("o").alias("o_b")), "b").where(F.col("o_b") * 100 >= percent * F.col("n_b"))
    other = other.withColumn("size", size_class(F.col("n_b")))
    fits = F.least("o", "o_b") * (100 + percent) >= percent * (F.col("n") + F.col("n_b"))
    return few.join(other, ["key", "size"]).where(open_pair & fits).select("id", "b").union(met)


#: The query op1 in DuckDB's SQL: every pair of distinct sets with a common shingle is counted, on the shingles' own text.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM cut),
d AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM s GROUP BY doc_id),
class AS (SELECT digest, min(doc_id) AS id, any_value(n) AS n FROM d GROUP BY digest),
own AS (SELECT id, n, s FROM class JOIN s ON s.doc_id = class.id),
pair AS (SELECT x.id AS a, y.id AS b FROM own x JOIN own y ON x.s = y.s AND x.id < y.id AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT id AS a, id AS b FROM class UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
part AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, coalesce(d.n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN class USING (digest) LEFT JOIN part USING (id)
"""
