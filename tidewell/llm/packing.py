"""Token ids packed into rows of fixed length by best fit decreasing over the whole table.

Best fit decreasing only asks how many pieces there are of each length, and a
row of capacity C has C lengths.  So the tasks encode and cut the documents
and count the pieces by length; the driver packs these C counts, whole groups
of equal rows at once, with a segment tree over the free capacities; and each
piece finds its row from its number among the pieces of its length.  A shuffle
brings the pieces of a block of rows together.  Pieces that fill a row stay
where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, exact
from .common import materialize, pieces, texts_of

#: Rows that are put together at once, and the most rows of counts (24 bytes each) that go to all tasks; more are joined by a shuffle.
BLOCK, BROADCAST = 256, 1_000_000


class Capacities:
    """A segment tree over free capacities 0..size: the least one that is at least so large and that a row has."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The fullest row with that much free, and how much it has; it leaves the tree."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.rows[free].pop(), free


class Plan:
    """How pieces of each length go into rows; bounded by the capacity, whatever the number of pieces.

    Segments of a length, in the order of its pieces: number of the first
    piece, first row, pieces in each row, and where the first stands there.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        tree = Capacities(capacity)
        #: Rows of each group, where its first piece of the last length stands, and the (length, times, place) that fill it.
        groups: list[tuple[int, tuple]] = []

        def keep(rows: int, filled: tuple, free: int) -> None:
            groups.append((rows, filled))
            if free:
                tree.add(free, len(groups) - 1)

        for size in sorted((s for s in counts if counts[s]), reverse=True):
            left = counts[size]
            while left:
                found = tree.take(size)
                group, free = found if found else (-1, capacity)
                rows, filled = groups[group] if found else (left, ())
                if found:
                    groups[group] = (0, ())
                times = free // size
                full = min(rows, left // times)
                if full:
                    keep(full, (*filled, (size, times, capacity - free)), free - times * size)
                left -= full * times
                rows -= full
                if left and rows:
                    keep(1, (*filled, (size, left, capacity - free)), free - left * size)
                    left, rows = 0, rows - 1
                if found and rows:
                    keep(rows, filled, free)
        self.rows = 0
        segments: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        for rows, filled in groups:
            for size, times, place in filled if rows else ():
                segments.setdefault(size, []).append((used.get(size, 0), self.rows, times, place))
                used[size] = used.get(size, 0) + rows * times
            self.rows += rows
        self.segments = {s: np.array(x, np.int64) for s, x in segments.items()}

    def place(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in it of the pieces with these numbers among those of their lengths."""
        row, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            on = np.flatnonzero(sizes == size)
            table = self.segments[int(size)]
            of = table[np.searchsorted(table[:, 0], numbers[on], side="right") - 1]
            inside = numbers[on] - of[:, 0]
            row[on] = of[:, 1] + inside // of[:, 2]
            at[on] = of[:, 3] + inside % of[:, 2] * size
        return row, at


PIECES = "part long, number long, size int, doc_id long, start long, ids binary"
PACKED = "pack_id long, n_tokens int, n_segments int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"
SCHEMA = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())])


def cut(docs: DataFrame, path: str, capacity: int, end_id: int | None) -> DataFrame:
    """Pieces of at most capacity tokens of the documents, numbered in each task among those of their length."""
    plain = exact(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = codec(path, plain), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, "text"):
            ids, off = tool.encode_batch(texts_of(batch.column("text")))
            number, size, doc, starts, packed = [], [], [], [], []
            for d, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1], off[1:], strict=True):
                own = (ids[a:b] if end_id is None else np.append(ids[a:b], np.uint32(end_id))).astype("<u4")
                for start in range(0, len(own), capacity):
                    piece = own[start : start + capacity]
                    number.append(int(seen[len(piece)]))
                    seen[len(piece)] += 1
                    size.append(len(piece))
                    doc.append(d)
                    starts.append(start)
                    packed.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part)), pa.array(number, pa.int64()), pa.array(size, pa.int32()), pa.array(doc, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], names=["part", "number", "size", "doc_id", "start", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def assembled(rows: pa.Table, capacity: int, pad_id: int) -> pa.Table:
    """Packed rows from all their pieces."""
    rows = rows.sort_by([("row", "ascending"), ("place", "ascending")])
    row, size = rows.column("row").to_numpy(), rows.column("size").to_numpy()
    packs, first, many = np.unique(row, return_index=True, return_counts=True)
    filled = np.add.reduceat(size, first)
    matrix = np.full((len(packs), capacity), pad_id, "<u4")
    matrix[np.arange(capacity) < filled[:, None]] = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4")
    ends = np.cumsum(size) - np.repeat(np.cumsum(filled) - filled, many)
    begins = ends - size
    lists = pa.array(np.append(first, len(row)), pa.int32())
    closed = np.insert(ends, first, 0)
    return pa.Table.from_arrays([
        pa.array(packs), pa.array(filled, pa.int32()), pa.array(many, pa.int32()),
        pa.ListArray.from_arrays(lists, rows.column("doc_id").combine_chunks()), pa.ListArray.from_arrays(lists, rows.column("start").combine_chunks()),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(row)) + np.arange(len(packs) + 1), pa.int32()), pa.array(closed, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(begins, pa.int32())),
        pa.array([m.tobytes() for m in matrix], pa.binary()),
    ], schema=SCHEMA)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int | None = None, pad_id: int = 0) -> DataFrame:
    """One row per packed row of capacity tokens.

    docs: (doc_id, text); more columns are ignored.  ids: capacity
    little-endian unsigned 32-bit ids, padded with pad_id after n_tokens.
    cu_seqlens: the cumulative segment lengths from 0; position_resets: where
    positions start again at 0.  Segment i holds the tokens of document
    doc_ids[i] from its token doc_starts[i] on: documents longer than capacity
    are cut into pieces and lose nothing.  end_id, if given, ends every
    document, so that an empty or null text is a segment of one token;
    without it such a text has no segment.  An empty table gives no rows;
    repeated rows are packed as often as they stand there.  pack_id numbers
    the rows.  Their fill is best fit decreasing over the whole table and
    doesn't depend on the partitions.
    """
    if capacity < 1:
        raise ValueError("a row has one token at least")
    made = materialize(cut(docs, path, capacity, end_id), "pieces", compression="zstd")
    counts = materialize(made.groupBy("part", "size").agg(F.count("*").alias("many")), "counts")
    of_size = {r["size"]: r["many"] for r in counts.groupBy("size").agg(F.sum("many").alias("many")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Plan(of_size, capacity))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST:
        offsets = F.broadcast(offsets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = shared.value.place(batch.column("size").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(row // BLOCK), pa.array(row), pa.array(at), *(batch.column(c) for c in ("size", "doc_id", "start", "ids"))], names=["block", "row", "place", "size", "doc_id", "start", "ids"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield from assembled(pa.Table.from_batches([batch.slice(at, BLOCK)]), capacity, pad_id).to_batches()

    def placed(some: DataFrame) -> DataFrame:
        numbered = some.join(offsets, ["part", "size"]).select((F.col("number") + F.col("before")).alias("number"), "size", "doc_id", "start", "ids")
        return numbered.mapInArrow(place, "block long, row long, place long, size int, doc_id long, start long, ids binary")

    together = placed(made.where(F.col("size") < capacity)).groupBy("block").applyInArrow(lambda rows: assembled(rows, capacity, pad_id), PACKED)
    return together.union(placed(made.where(F.col("size") == capacity)).mapInArrow(alone, PACKED))


def write_packed(packed: DataFrame, folder: str) -> None:
    """Write the packed rows as Parquet, ids as fixed-length binary; any number of executors write at once."""
    packed.write.mode("overwrite").parquet(folder)
