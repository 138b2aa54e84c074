"""A hierarchical Pitman-Yor language model over whole texts.

A word is drawn in the restaurant of its two preceding words, whose parent is
that of the one preceding word.  Every word has these restaurants and is a dish
of its own there.  Their parent is a restaurant of classes, whose parent is the
root: the most frequent words are classes of their own, the others are folded
by hash, and the dishes are the most frequent words and one for all others,
which the root tells apart.  The root's base measure spells
words: byte by byte, in restaurants for the three, two, one and no preceding
bytes (folded to 32 classes), each the parent of the next.  The tables of a
restaurant are customers of its parent; the root itself seats every token.
Seating is sampled by Gibbs sweeps in blocks: all customers of one dish of one
restaurant are seated again, in turn, by the Chinese-restaurant probabilities
given the other tables.  Predictive probabilities are averaged over sweeps.

Scale: words are counted with map-side sums; words with at least 1 / HEAD of
the tokens (so 2 * HEAD at most) go to the tasks as one table.  Each piece of
texts asks for its other words once, by hash bucket, whatever their number, and
is then kept as numbers of words.  The numbers of restaurants and dishes of the
contexts and of the spelling are fixed whatever the input, so the executors
count their customers and the driver draws their seating.  The restaurants of
the words themselves meet all their tokens by hash bucket, which seats them and
scores; one with more than PART tokens is told apart by hashes of the word
before.  That takes ROUNDS rounds, each with its share of the buckets, so that
only one round's tokens stand on disk; what a step has used up is deleted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, materialize, pieces
from .shingles import _LOWER, U64, mix, word_hashes

CLASSES, SYMBOLS, STOP = 32, 257, 256
#: Sweeps before and of the average.
BURN_IN, SAMPLES = 1, 2
CONTEXT_BURN_IN, CONTEXT_SAMPLES = 3, 6
STRENGTH = 1.0
#: New tables of a dish that are waited for one by one.
WAITS = 32
#: Words that are at least 1 / HEAD of the training tokens are kept in every task: HEAD of them at most.
HEAD = 1 << 17
#: Tokens for each hash bucket.
BUCKET = 1 << 22
#: Context words with a restaurant of their own, classes of all others, context words with restaurants for the word before them too, and dishes.
OWN, FOLDED, PAIRED, DISHES = 512, 512, 63, 1024
#: Tokens for each bucket of the words' own restaurants, and the most that one of these restaurants is meant to hold.
MEETING, PART = 1 << 19, 1 << 18
#: Places of one restaurant in a piece of text, above which equal ones of a text go as one.
CROWD = 1024
#: Bytes of texts that ask for their words together, and rounds in which their tokens meet.
TOGETHER, ROUNDS = 8 << 20, 2
#: Sums of texts that a task holds before it gives them out.
SUMS = 1 << 21
#: The class of the start of a text.
START = OWN + FOLDED
END, BEGIN = mix(np.array([0x5EED, 0xBE61], U64))
_FOLD = np.full(256, 28, np.int64)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[48:58] = 27
_FOLD[0x80:0xA0] = 30
_FOLD[0xA0:0xC0] = 31
_FOLD[0xC0:] = 29
#: First row of the contexts of 3, 2, 1 and 0 classes.
LEVELS = (0, CLASSES**3, CLASSES**3 + CLASSES**2, CLASSES**3 + CLASSES**2 + CLASSES)
CONTEXTS = LEVELS[3] + 1


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seeds and the step only, so that a task run again draws the same."""
    return ((mix(seed + U64(step * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53


def seats(customers: np.ndarray, mass: np.ndarray, discount: float, seed: np.ndarray, step: int) -> np.ndarray:
    """Tables of each dish after its customers sat down in turn.

    mass: (strength + discount * all tables) * the parent's probability.
    Customer k + 1 opens a table with chance mass / (mass + k - discount * t).
    The first 16 sit down one by one; after that the wait for the next new
    table is drawn, and after WAITS tables the number of new ones among each
    next eighth of the customers (a binomial number by its normal form), so
    the steps grow with the logarithm of the customers.
    """
    tables = (customers > 0).astype(np.float64)
    for k in range(1, 16):
        on = np.flatnonzero(customers > k)
        if not len(on):
            return tables
        chance = mass[on] / (mass[on] + k - discount * tables[on])
        tables[on] += uniform(seed[on], step + k) < chance
    on = np.flatnonzero(customers > 16)
    at = np.full(len(on), 16.0)
    k = 16
    while len(on) and k < 16 + WAITS:
        free = at - discount * tables[on]
        wait = np.exp(np.minimum(-np.log(uniform(seed[on], step + k)) / np.maximum(mass[on], 1e-300), 60.0))
        at = np.floor(discount * tables[on] + free * wait) + 1
        sits = at <= customers[on]
        on, at = on[sits], at[sits]
        tables[on] += 1
        k += 1
    while len(on):
        block = np.minimum(np.floor(at / 8) + 1, customers[on] - at)
        chance = mass[on] / (mass[on] + at - discount * tables[on])
        chance = mass[on] / (mass[on] + at + block / 2 - discount * (tables[on] + chance * block / 2))  # at the middle of the block
        normal = np.sqrt(-2 * np.log(uniform(seed[on], step + k))) * np.cos(2 * np.pi * uniform(seed[on], step + k + 50_000))
        tables[on] += np.clip(np.rint(block * chance + np.sqrt(block * chance * (1 - chance)) * normal), 0, block)
        at = at + block
        on, at = on[at < customers[on]], at[at < customers[on]]
        k += 1
    return tables


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context of three classes and symbol of each byte and stop of the words, and where each word starts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    stops = starts + sizes - 1
    classes = _FOLD[symbols]
    symbols[stops] = STOP
    classes[stops] = 0
    context = np.zeros(len(symbols), np.int64)
    for back in (1, 2, 3):
        before = np.zeros_like(classes)
        before[back:] = classes[:-back]
        inside = np.arange(len(symbols)) - np.repeat(starts, sizes) >= back
        context += np.where(inside, before, 0) * CLASSES ** (back - 1)
    return context, symbols, starts


@dataclass
class Spelling:
    """Predictive log probabilities of the seen contexts; row_of gives the row of a context of three classes."""

    row_of: np.ndarray
    logs: np.ndarray

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        context, symbols, starts = spelled(words)
        return np.add.reduceat(self.logs[self.row_of[context], symbols].astype(np.float64), starts)


def seat_spelling(context: np.ndarray, symbol: np.ndarray, count: np.ndarray, before: dict, sweep: int) -> tuple[Spelling, dict]:
    """One sweep over the spelling restaurants, from the longest contexts down, then their predictive probabilities.

    before: the state of the sweep before, empty at first.
    """
    state: dict = {}
    rows, syms, customers = context, symbol, count.astype(np.float64)
    for level in range(4):
        dish = rows * SYMBOLS + syms
        unique, inverse = np.unique(dish, return_inverse=True)
        customers = np.bincount(inverse, customers, len(unique))
        rows, syms = unique // SYMBOLS, unique % SYMBOLS
        ones, twos = (customers == 1).sum(), (customers == 2).sum()
        discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))
        parent = before["p"][level + 1](rows, syms) if before else np.full(len(rows), 1 / SYMBOLS)
        all_tables = before["tables"][level][rows] if before else np.bincount(rows, minlength=CLASSES ** (3 - level))[rows]
        tables = seats(customers, (STRENGTH + discount * all_tables) * parent, discount, mix(unique.astype(U64) + U64(level)), 100_000 * (sweep + 1))
        state[level] = (rows, syms, customers, tables, discount)
        rows, customers = (rows % CLASSES ** (2 - level) if level < 3 else rows), tables
    row_of = np.zeros(1, np.int64)
    table = np.full((1, SYMBOLS), 1 / SYMBOLS)
    predict: dict[int, Callable] = {4: lambda r, s: np.full(len(r), 1 / SYMBOLS)}
    totals: dict[int, np.ndarray] = {}
    for level in (3, 2, 1, 0):
        rows, syms, customers, tables, discount = state[level]
        width = CLASSES ** (3 - level)
        seen, where = np.unique(rows, return_inverse=True)
        if level < 3:
            row_of = np.tile(row_of, CLASSES) if len(row_of) < width else row_of
        own = table[row_of[seen]] if len(seen) else table[:0]
        c, t = np.bincount(where, customers, len(seen)), np.bincount(where, tables, len(seen))
        new = own * ((STRENGTH + discount * t) / (STRENGTH + c))[:, None]
        new[where, syms] += np.maximum(customers - discount * tables, 0) / (STRENGTH + c[where])
        row_of = row_of.copy()
        row_of[seen] = len(table) + np.arange(len(seen))
        table = np.concatenate((table, new))
        totals[level] = np.zeros(width)
        totals[level][seen] = t
        predict[level] = lambda r, s, row_of=row_of, table=table, width=width: table[row_of[r % width], s]
    parents = {level + 1: (lambda r, s, f=predict[level + 1]: f(r, s)) for level in range(4)}
    return Spelling(row_of, np.log10(table).astype(np.float32)), {"p": parents, "tables": totals}


@dataclass
class Root:
    """What a sweep knows of the root: its tables and the spelling that was drawn with them."""

    spelling: Spelling
    tables: float


def _mass(root: Root, words: list[bytes], discount: float) -> np.ndarray:
    return (STRENGTH + discount * root.tables) * 10.0 ** root.spelling.log10(words)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile remove their shuffle files when they end; what they give must be written or collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def written(df: DataFrame, name: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        return materialize(df, name, "zstd")


def used_up(table: DataFrame) -> None:
    """Delete the files of a table that written() gave."""
    jvm, files = table.sparkSession.sparkContext._jvm, table.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def packed(x: np.ndarray) -> bytes:
    """The numbers by planes of their bytes, those of zeros left out, compressed."""
    if not len(x):
        return b""
    wide = x.itemsize if x.dtype.kind != "u" else -(-int(x.max()).bit_length() // 8)
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :wide].T)
    return len(x).to_bytes(8, "little") + bytes([wide]) + (pa.compress(flat, "zstd", asbytes=True) if wide else b"")


def unpacked(data: bytes, kind: str) -> np.ndarray:
    many, wide = (int.from_bytes(data[:8], "little"), data[8]) if data else (0, 0)
    out = np.zeros((many, np.dtype(kind).itemsize), np.uint8)
    if wide:
        out[:, :wide] = np.frombuffer(pa.decompress(data[9:], many * wide, "zstd", asbytes=True), np.uint8).reshape(wide, many).T
    return out.view(kind).reshape(-1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers, a place of each, and where each number is among them."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c, every) of (text, held_out): occurrences of each word, and of the end (the empty word), in training and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 16 << 20):
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            texts = bytes_of(batch.column("text"))
            counts = [Counter(b" ".join(t for t, h in zip(texts, held, strict=True) if h == part).translate(_LOWER).split()) for part in (False, True)]
            for part in (False, True):
                counts[part][b""] = int((held == part).sum())
            for part in (False, True):
                words, every = list(counts[part]), np.fromiter(counts[part].values(), np.int64, len(counts[part]))
                for at in range(0, len(words), 100_000):
                    some = every[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"word": pa.array(words[at : at + 100_000], pa.binary()), "c": some * (not part), "every": some})

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long, every long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def _hashes(words: list[bytes]) -> np.ndarray:
    out = np.full(len(words), END, U64)
    full = [w for w in words if w]
    if full:
        out[np.fromiter(map(len, words), np.int64, len(words)) > 0] = word_hashes([b" ".join(full)])[0]
    return out


def _sweep(words: DataFrame, root: Root | None, discount: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Seat the root's customers and give the spelling's: context, symbol and count, and the root's tables."""
    shared = words.sparkSession.sparkContext.broadcast(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, total = np.zeros(CLASSES**3 * SYMBOLS), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                some = batch.slice(at, 50_000)
                w, c = some.column("word").to_pylist(), some.column("c").to_numpy()
                t = np.ones(len(w)) if shared.value is None else seats(c, _mass(shared.value, w, discount), discount, _hashes(w), step)
                context, symbols, starts = spelled(w)
                np.add.at(drawn, context * SYMBOLS + symbols, np.repeat(t, np.diff(np.append(starts, len(context)))))
                total += t.sum()
        if total:
            dish = np.flatnonzero(drawn)
            yield pa.RecordBatch.from_pydict({"dish": np.append(-1, dish), "n": np.append(total, drawn[dish])})

    with shuffles_removed(words.sparkSession):
        rows = words.where("c > 0").select("word", "c").mapInArrow(run, "dish long, n double").groupBy("dish").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values("dish")
    shared.destroy()
    total = float(rows.n[rows.dish < 0].sum())
    rows = rows[rows.dish >= 0]
    dish = rows.dish.to_numpy()
    return dish // SYMBOLS, dish % SYMBOLS, rows.n.to_numpy(), total


def classes(rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(rank < OWN, rank, OWN + (h % U64(FOLDED)).astype(np.int64))


def classes_before(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the tokens' classes: that of the token before each, and that of the one before that."""
    one = np.full(len(kind), START)
    one[1:] = np.where(first[1:], START, kind[:-1])
    two = np.full(len(kind), START)
    two[1:] = np.where(first[1:], START, one[:-1])
    return one, np.minimum(two, PAIRED)


class Contexts:
    """Classes and dishes of words, from the head's word hashes, ranks by frequency and root probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> None:
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -counts))] = np.arange(len(keys))
        self.keys, self.rank = keys, rank
        own = np.full(DISHES, 0.0)
        own[rank[rank < DISHES]] = 10.0 ** logs[rank < DISHES]
        #: Root probabilities of the dishes; the last is that of all other words.
        self.root = np.append(own, max(1e-9, 1 - own.sum()))

    def of(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Dish of each token, class of the token before it, and of the one before that; first: whether a token starts a text."""
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        rank = np.where(self.keys[at] == h, self.rank[at], DISHES) if len(self.keys) else np.full(len(h), DISHES)
        return np.minimum(rank, DISHES), *classes_before(classes(rank, h), first)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of the texts and of an end for each, whether each starts a text, and its text."""
    h, off = word_hashes(texts)
    sizes = np.diff(off) + 1
    ends = np.cumsum(sizes) - 1
    out = np.empty(len(h) + len(texts), U64)
    out[ends] = END
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = h
    first = np.zeros(len(out), bool)
    first[ends - sizes + 1] = True
    return out, first, np.repeat(np.arange(len(texts)), sizes)


class Head:
    """The head's words, the most frequent first: hashes, counts and log10 probabilities; the number of a word is its place."""

    def __init__(self, h: np.ndarray, c: np.ndarray, p: np.ndarray) -> None:
        order = np.lexsort((h, -c))
        self.h, self.c, self.p = h[order], c[order], p[order]
        self.sorted = np.argsort(self.h)

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, and whether it has one."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.sorted[np.minimum(np.searchsorted(self.h, h, sorter=self.sorted), len(self.h) - 1)]
        return at, self.h[at] == h


class Piece:
    """The tokens of a row of numbered texts; those of words outside the head have numbers behind the head's."""

    def __init__(self, row: dict, head: Head) -> None:
        self.code, sizes = unpacked(row["code"], "<u4"), unpacked(row["sizes"], "<u4").astype(np.int64)
        self.held = unpacked(row["flags"], "<u1") % 2
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.zeros(len(self.code), bool)
        self.first[np.cumsum(sizes) - sizes] = True
        self.words, self.known = np.append(head.h, unpacked(row["h"], "<u8")), len(head.h)
        rank = np.minimum(np.arange(len(self.words)), DISHES)
        rank[self.known :] = DISHES
        self.dish = rank[self.code]
        self.one, self.two = classes_before(classes(rank, self.words)[self.code], self.first)


def context_counts(numbered: DataFrame, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Customers of each dish after one class, and after a class and one of the PAIRED words, in the texts that aren't held out."""
    shared = numbered.sparkSession.sparkContext.broadcast(head)
    width = DISHES + 1
    singles = (START + 1) * width
    cells_n, blocks = singles + PAIRED * (PAIRED + 1) * width, 80

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells_n, np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece(batch.slice(i, 1).to_pylist()[0], shared.value)
                learnt = piece.held[piece.doc] == 0
                dish, one, two = piece.dish[learnt], piece.one[learnt], piece.two[learnt]
                np.add.at(seen, one * width + dish, 1)
                on = one < PAIRED
                np.add.at(seen, singles + (one[on] * (PAIRED + 1) + two[on]) * width + dish[on], 1)
        for k in range(blocks):  # every so many cells, so that each block has its share of frequent ones
            cells = np.flatnonzero(seen[k::blocks])
            if len(cells):
                yield pa.RecordBatch.from_pydict({"block": [k], "cells": [cells.astype("<u4").tobytes()], "n": [seen[k::blocks][cells].astype("<i8").tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(-(-cells_n // blocks), np.int64)
        for cells, n in zip(group.column("cells").to_pylist(), group.column("n").to_pylist(), strict=True):
            total[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<i8")
        cells = np.flatnonzero(total)
        return pa.table({"block": group.column("block")[:1], "cells": pa.array([cells.astype("<u4").tobytes()]), "n": pa.array([total[cells].astype("<i8").tobytes()])})

    schema = "block long, cells binary, n binary"
    out = np.zeros(cells_n)
    with shuffles_removed(numbered.sparkSession):
        rows = numbered.select("code", "sizes", "flags", "h").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow().to_pylist()
    shared.destroy()
    for row in rows:
        out[row["block"] + blocks * np.frombuffer(row["cells"], "<u4").astype(np.int64)] = np.frombuffer(row["n"], "<i8")
    return out[:singles].reshape(START + 1, width), out[singles:].reshape(PAIRED, PAIRED + 1, width)


def _discount(customers: np.ndarray) -> float:
    ones, twos = (customers == 1).sum(), (customers == 2).sum()
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))


def _drawn(customers: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float, seed: int, step: int) -> np.ndarray:
    """Tables of the dishes (columns) of restaurants (rows), seated again given the tables so far."""
    rows, dishes = np.nonzero(customers)
    mass = (STRENGTH + discount * tables.sum(1)[rows]) * parent[rows if len(parent) > 1 else 0, dishes]
    out = np.zeros_like(customers)
    out[rows, dishes] = seats(customers[rows, dishes], mass, discount, mix((rows * (DISHES + 1) + dishes).astype(U64) + U64(seed << 32)), step)
    return out


def _predicted(customers: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    every = customers.sum(1, keepdims=True)
    return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * tables.sum(1, keepdims=True)) * parent) / (STRENGTH + every)


def seat_contexts(singles: np.ndarray, pairs: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 of the dishes' predictive probabilities after one class and after two, averaged over sweeps.

    The last column, of all words that are no dish, is relative to the root's.
    """
    customers, tables = singles.copy(), (singles > 0).astype(float)
    tables2 = (pairs > 0).astype(float)
    discount2, base = _discount(pairs), root[None, :]
    total, total2 = np.zeros_like(singles), np.zeros(pairs.shape, np.float32)
    for sweep in range(CONTEXT_BURN_IN + CONTEXT_SAMPLES):
        customers[:PAIRED] = tables2.sum(1)
        discount = _discount(customers)
        tables = _drawn(customers, np.minimum(tables, customers), base, discount, 1 << 20, 1000 * (sweep + 1))
        one = _predicted(customers, tables, base, discount)
        kept = sweep >= CONTEXT_BURN_IN
        for u in range(PAIRED):
            tables2[u] = _drawn(pairs[u], tables2[u], one[u : u + 1], discount2, u, 1000 * (sweep + 1))
            if kept:
                total2[u] += _predicted(pairs[u], tables2[u], one[u : u + 1], discount2)
        if kept:
            total += one
    logs, logs2 = (np.log10(np.maximum(x / CONTEXT_SAMPLES, 1e-30)) for x in (total, total2))
    logs[:, -1] -= np.log10(root[-1])
    logs2[:, :, -1] -= np.log10(root[-1])
    return logs.astype(np.float32), logs2.astype(np.float32)


def before(code: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words one, two and three before each token; none where the text has none."""
    out = [code.astype(np.int64)]
    for _ in range(3):
        back = np.full(len(code), none)
        back[1:] = np.where(first[1:], none, out[-1][:-1])
        out.append(back)
    return out[1], out[2], out[3]


def alike(some: np.ndarray, m: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places some by restaurant m, and how many each stands for: in a restaurant with many, those with the same names are one."""
    some = some[np.argsort(m[some])]
    times = np.ones(len(some), np.int64)
    new = np.append(True, m[some[1:]] != m[some[:-1]])[: len(some)]
    room = np.cumsum(new) - 1
    crowd = np.bincount(room)[room] > CROWD if len(some) else new
    if not crowd.any():
        return some, times
    key = m[some[crowd]]
    for name in names:
        key = mix(key) + name[some[crowd]].astype(U64)
    _, one, place = distinct(key)
    some, times = np.append(some[~crowd], some[crowd][one]), np.append(times[~crowd], np.bincount(place))
    order = np.argsort(m[some])
    return some[order], times[order]


def predicted_words(m: np.ndarray, u: np.ndarray, w: np.ndarray, log: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Log10 of the predictive probability of each token w in the restaurant of u within that of m, averaged over sweeps.

    log: that of w in the parent of m's restaurant, which is the same wherever
    m and w are.  learnt: how many customers the token is.
    """
    dish = mix(m + mix(w))
    cells, at, cell = distinct(mix(dish + mix(mix(u) + U64(0x3C6EF372FE94F82B))))
    customers2 = np.bincount(cell, learnt, len(cells))
    room2 = distinct(mix(m[at] + mix(mix(u[at]) + U64(0x78DDE6E5FD29F057))))[2]
    dishes, at1, up = distinct(dish[at])
    at1 = at[at1]
    room = distinct(m[at1])[2]
    fresh = np.bincount(up, customers2, len(dishes)) == 0  # in proportion to the parent, whose probability may be too small for a float
    parent = np.where(fresh, 1.0, 10.0 ** log[at1])
    tables2, tables = (customers2 > 0).astype(float), np.zeros(len(dishes))
    discount2, sums2, total = _discount(customers2), np.bincount(room2, customers2), np.zeros(len(cells))
    for sweep in range(BURN_IN + SAMPLES):
        customers = np.bincount(up, tables2, len(dishes))
        discount, sums = _discount(customers), np.bincount(room, customers)
        tables = np.minimum(tables, customers) if sweep else (customers > 0).astype(float)
        tables = seats(customers, (STRENGTH + discount * np.bincount(room, tables)[room]) * parent, discount, dishes, 1000 * (sweep + 1))
        one = (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * np.bincount(room, tables)[room]) * parent) / (STRENGTH + sums[room])
        own = one[up]
        tables2 = seats(customers2, (STRENGTH + discount2 * np.bincount(room2, tables2)[room2]) * own, discount2, cells, 1000 * (sweep + 1))
        if sweep >= BURN_IN:
            total += (np.maximum(customers2 - discount2 * tables2, 0) + (STRENGTH + discount2 * np.bincount(room2, tables2)[room2]) * own) / (STRENGTH + sums2[room2])
    return (np.log10(total / SAMPLES) + np.where(fresh, log[at1], 0.0)[up])[cell]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs.

    docs: doc_id, text, held_out (boolean), more columns, which are ignored.
    The model and the base are learnt from the texts that aren't held out.  A
    text is its words, lower-cased in A-Z, then one end; a null or empty text
    is one end.  score is the model's log10 probability of the whole text,
    perplexity 10 to minus its mean over the tokens.  A null held_out counts as false.  Repeated rows are scored
    each and learnt from as often as they stand there.  Without training texts the
    base measure alone scores.  An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    spark = docs.sparkSession
    words = written(vocabulary(docs), "words")
    known = F.col("c") > 0
    n, v, every, texts_n, ones, twos = (int(x or 0) for x in words.agg(F.sum("c"), F.sum(known.cast("long")), F.sum("every"), F.sum(F.when(F.length("word") == 0, F.col("every"))), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first())
    discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))
    roots: list[Root | None] = [None]
    state: dict = {}
    for sweep in range(BURN_IN + SAMPLES):
        context, symbol, count, tables = _sweep(words, roots[-1], discount, 1000 * (sweep + 1))
        spelling, state = seat_spelling(context, symbol, count, state, sweep)
        roots.append(Root(spelling, tables))
    chain = roots[-SAMPLES - 1 :]
    shared = spark.sparkContext.broadcast(chain)
    salts = max(1, -(-every // (HEAD * BUCKET)))
    buckets = max(1, -(-every // (BUCKET * salts)))

    def model(w: list[bytes], c: np.ndarray) -> np.ndarray:
        """Log10 of the predictive probability, averaged over the samples."""
        total = np.zeros(len(w))
        for i, root in enumerate(shared.value[1:]):
            before = shared.value[i]
            mass = np.zeros(len(w)) if before is None else _mass(before, w, discount)
            t = (c > 0).astype(float) if before is None else seats(c, mass, discount, _hashes(w), 1000 * (BURN_IN + i + 1))
            total += (np.maximum(c - discount * t, 0) + _mass(root, w, discount)) / (STRENGTH + n)
        return np.log10(total / SAMPLES)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (n + v + 1.0))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                some = batch.slice(at, 50_000)
                w, c = some.column("word").to_pylist(), some.column("c").to_numpy()
                yield pa.RecordBatch.from_pydict({"h": _hashes(w).view(np.int64), "c": pa.array(c, pa.int64()), "every": some.column("every"), "p": pa.array(model(w, c), pa.float64())})

    described_words = written(words.select("word", "c", "every").mapInArrow(described, "h long, c long, every long, p double"), "model")
    used_up(words)
    shared.destroy()
    in_head = (known & (F.col("c") * HEAD >= n)) | (F.col("every") * HEAD >= every)
    head_rows = described_words.where(in_head).toArrow()
    own = Head(head_rows.column("h").to_numpy().view(U64), head_rows.column("c").to_numpy(), head_rows.column("p").to_numpy())
    head = spark.sparkContext.broadcast(own)
    rows_schema = "kind int, bucket long, batch string, code binary, sizes binary, ids binary, flags binary, h binary, c binary, p binary"
    row_columns = [x.split()[0] for x in rows_schema.split(", ")]
    row_arrow = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("batch", pa.string()), *((x, pa.binary()) for x in row_columns[3:])])

    def rows_of(rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist([dict.fromkeys(row_columns[3:], b"") | r for r in rows], schema=row_arrow)

    def cuts(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each bucket that occurs in the sorted buckets, and where it starts and ends."""
        found, first = np.unique(of, return_index=True)
        return zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(of)][: len(found)], strict=True)

    def tail_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, p = batch.column("h").to_numpy().view(U64), batch.column("c").to_numpy(), batch.column("p").to_numpy()
            of = (h % U64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            for k, a, b in cuts(of[order]):
                part = order[a:b]
                mine = {"kind": 2, "batch": "", "h": packed(h[part]), "c": packed(c[part]), "p": packed(p[part])}
                yield from rows_of([mine | {"bucket": k * salts + salt} for salt in range(salts)]).to_batches()

    def numbered_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each piece as numbers of words, and what words outside the head they ask for, by bucket: their numbers follow the head's in this order."""
        task, number = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", TOGETHER):
            h, _, doc = tokens_of(bytes_of(batch.column("text")))
            found, _, place = distinct(h)
            code, hit = head.value.numbers(found)
            rest = np.flatnonzero(~hit)
            of = (found[rest] % U64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            code[rest[order]] = len(head.value.h) + np.arange(len(rest))
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = np.where(missing, 0, batch.column("doc_id").to_numpy(zero_copy_only=False)).astype(np.int64)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype("<u1")
            name, salt = f"{task}-{number}", (task + number) % salts
            rows = [{"kind": 0, "bucket": -1, "batch": name, "code": packed(code[place].astype("<u4")), "sizes": packed(np.bincount(doc, minlength=batch.num_rows).astype("<u4")), "ids": packed(ids), "flags": packed(held + 2 * missing.astype("<u1"))}]
            rows += [{"kind": 1, "bucket": k * salts + salt, "batch": name, "h": packed(found[rest[order[a:b]]])} for k, a, b in cuts(of[order])]
            yield from rows_of(rows).to_batches()
            number += 1

    def meet(group: pa.Table) -> pa.Table:
        """Counts and probabilities of the words that the pieces ask for in one bucket."""
        rows = group.to_pylist()
        model_rows = [r for r in rows if r["kind"] == 2]
        h, c, p = (np.concatenate([np.zeros(0, kind), *(unpacked(r[x], kind) for r in model_rows)]) for x, kind in (("h", "<u8"), ("c", "<i8"), ("p", "<f8")))
        order = np.argsort(h)
        h, c, p = h[order], c[order], p[order]
        out = []
        for r in rows:
            if r["kind"] == 1:
                at = np.searchsorted(h, unpacked(r["h"], "<u8"))
                out.append({"kind": 1, "bucket": r["bucket"], "batch": r["batch"], "h": r["h"], "c": packed(c[at]), "p": packed(p[at])})
        return rows_of(out)

    def gathered(group: pa.Table) -> pa.Table:
        """A piece of numbered texts with its words outside the head, and its sums: tokens, known tokens and base scores."""
        first, *rows = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        h, c, p = (np.concatenate([np.zeros(0, kind), *(unpacked(r[x], kind) for r in rows)]) for x, kind in (("h", "<u8"), ("c", "<i8"), ("p", "<f8")))
        sizes, code = unpacked(first["sizes"], "<u4"), unpacked(first["code"], "<u4")
        doc, every_c = np.repeat(np.arange(len(sizes)), sizes), np.append(head.value.c, c)
        sums = np.stack((np.bincount(doc, every_c[code] > 0, len(sizes)), np.bincount(doc, base(every_c)[code], len(sizes))))
        return rows_of([first | {"h": packed(h), "c": packed(sums.reshape(-1)), "p": packed(p)}])

    tail = described_words.where(~in_head).select("h", "c", "p").mapInArrow(tail_words, rows_schema)
    told = written(docs.mapInArrow(numbered_texts, rows_schema), "told")
    met = told.where("kind = 1").union(tail).groupBy("bucket").applyInArrow(meet, rows_schema)
    numbered = written(told.where("kind = 0").union(met).groupBy("batch").applyInArrow(gathered, rows_schema), "numbered")
    used_up(told)
    used_up(described_words)

    contexts = Contexts(np.sort(own.h), own.c[own.sorted], own.p[own.sorted])
    singles, pairs = context_counts(numbered, own)
    # How many parts a word's restaurant has after each class; a folded class or dish is no single word's.
    pair_shares = 1 + (singles * (every / max(1, n)) // PART).astype(np.int32)
    pair_shares[OWN:START], pair_shares[:, DISHES] = 1, 1
    shares = np.append(1 + head_rows.column("every").to_numpy()[np.lexsort((head_rows.column("h").to_numpy().view(U64), -head_rows.column("c").to_numpy()))] // PART, 1)
    after = spark.sparkContext.broadcast((*seat_contexts(singles, pairs, contexts.root), pair_shares, shares))
    meetings = max(1, -(-every // MEETING))
    rounds = min(ROUNDS, meetings)

    def restaurants(piece: Piece, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Restaurant of the word before each token, or the part of it, and the number of the word before that."""
        pair_shares, shares = after.value[2:]
        names, none = np.append(piece.words, BEGIN), len(piece.words)
        v, u, t = before(piece.code, piece.first, none)
        rooms = mix(names + U64(7))
        m = mix(mix(mix(rooms)))[v]  # of words without parts and pairs
        parts = np.append(shares[np.minimum(np.arange(none), piece.known)], 1 + texts_n // PART)[v]
        of_pair = np.ones(len(v), np.int64)
        of_pair[1:] = pair_shares[piece.one[:-1], piece.dish[:-1]]
        of_pair[piece.first] = 1
        on = np.flatnonzero((piece.one < PAIRED) | (parts > 1) | (of_pair > 1))
        one, v, parts, of_pair, u_on, t_on = piece.one[on], v[on], parts[on], of_pair[on], u[on], t[on]
        some = mix(np.array([number], U64))  # a start has no word before it: texts by piece
        u_side, t_side = np.where(v == none, some, mix(names[u_on] + U64(3))), np.where(t_on == none, some, mix(names[t_on] + U64(5)))
        own = mix(rooms[v] + np.where(one < PAIRED, piece.two[on] + 1, 0).astype(U64))
        own = mix(own + u_side % parts.astype(U64))
        m[on] = mix(own + np.where(of_pair > 1, (u_side | U64(1)) + t_side % of_pair.astype(U64), U64(0)))
        return m, u

    sent_schema = "bucket long, batch string, w binary, u binary, doc binary, m binary, size binary, context binary, h binary, p binary, times binary"

    def sent(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The tokens of each piece by bucket of restaurants, those of this turn: a run for each restaurant, and the words outside the head that a bucket's tokens have."""
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    piece = Piece(row, head.value)
                    task, number = map(int, row["batch"].split("-"))
                    m, u = restaurants(piece, (task << 32) + number)
                    bucket = ((m >> U64(32)) * U64(meetings) >> U64(32)).astype(np.int64)  # it grows with the hash
                    doc = 2 * piece.doc + piece.held[piece.doc]
                    some, times = alike(np.flatnonzero(bucket % rounds == turn), m, u, piece.code, doc)
                    m, w, u, doc, bucket = m[some], piece.code[some].astype(np.int64), u[some], doc[some].astype("<u4"), bucket[some]
                    one, two = piece.one[some], piece.two[some]
                    context = np.where(one < PAIRED, START + 1 + one * (PAIRED + 1) + two, one).astype("<u2")
                    u = np.where(u == len(piece.words), 0, u + 1)  # 0: none
                    p, place = unpacked(row["p"], "<f8"), np.zeros(len(piece.words) + 1, np.int64)
                    for k, a, b in cuts(bucket):
                        own, mine, many = w[a:b], u[a:b], times[a:b]
                        edge = np.flatnonzero(np.append(True, m[a + 1 : b] != m[a : b - 1]))
                        on, off = np.flatnonzero(own >= piece.known), np.flatnonzero(mine > piece.known)
                        rare = np.unique(np.append(own[on], mine[off] - 1))
                        place[rare] = piece.known + np.arange(len(rare))
                        own[on], mine[off] = place[own[on]], place[mine[off] - 1] + 1
                        columns = {"w": own.astype("<u4"), "u": mine.astype("<u4"), "doc": doc[a:b], "m": m[a:b][edge], "size": np.diff(np.append(edge, b - a)).astype("<u4"), "context": context[a:b][edge], "h": piece.words[rare], "p": p[rare - piece.known], "times": many.astype("<u4") if (many > 1).any() else many[:0]}
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "batch": [row["batch"]], **{x: pa.array([packed(y)], pa.binary()) for x, y in columns.items()}})

        return run

    def followed(rows: list[dict], sums: dict[str, np.ndarray]) -> None:
        """Add the scores of the tokens of one bucket of restaurants to those of the texts of each batch."""
        one_logs, two_logs = after.value[:2]
        pair_logs, own, parts = two_logs.reshape(-1, DISHES + 1), head.value, []
        for r in rows:
            context = np.repeat(unpacked(r["context"], "<u2").astype(np.int64), unpacked(r["size"], "<u4"))
            m, (w, u) = np.repeat(unpacked(r["m"], "<u8"), unpacked(r["size"], "<u4")), (unpacked(r[x], "<u4").astype(np.int64) for x in "wu")
            h, p = unpacked(r["h"], "<u8"), unpacked(r["p"], "<f8")

            def looked_up(code: np.ndarray, frequent: np.ndarray, rare: np.ndarray) -> np.ndarray:
                off = np.flatnonzero(code >= len(own.h))
                out = frequent.take(code, mode="clip") if len(frequent) else np.zeros(len(code), rare.dtype)
                out[off] = rare[code[off] - len(own.h)]
                return out

            v = looked_up(np.maximum(u - 1, 0), own.h, h)
            v[u == 0] = BEGIN
            dish = np.where(w < len(own.h), np.minimum(w, DISHES), DISHES)
            single = context <= START
            log = np.where(single, one_logs[np.where(single, context, 0), dish], pair_logs[np.where(single, 0, context - START - 1), dish]) + np.where(dish == DISHES, looked_up(w, own.p, p), 0.0)
            parts.append((m, v, looked_up(w, own.h, h), log, unpacked(r["doc"], "<u4").astype(np.int64), unpacked(r["times"], "<u4") if r["times"] else np.ones(len(w), "<u4")))
        m, u, w, log, doc, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        scores = times * predicted_words(m, u, w, log, times * (doc % 2 == 0))
        ends = np.cumsum([len(x[0]) for x in parts])
        for r, part, to in zip(rows, parts, ends.tolist(), strict=True):
            doc = part[4] // 2
            mine = sums.get(r["batch"], np.zeros(0))
            mine = sums[r["batch"]] = np.append(mine, np.zeros(max(0, int(doc.max()) + 1 - len(mine))))
            np.add.at(mine, doc, scores[to - len(doc) : to])

    def given(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The sums of each batch, with the texts' numbers where few have any."""
        for name, x in sums.items():
            on = np.flatnonzero(x)
            few = 12 * len(on) < 8 * len(x)
            yield pa.RecordBatch.from_pydict({"batch": [name], "h": pa.array([on.astype("<u4").tobytes() if few else b""], pa.binary()), "x": pa.array([(x[on] if few else x).tobytes()], pa.binary())})
        sums.clear()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if rows and rows[0]["bucket"] != row["bucket"]:
                    followed(rows, sums)
                    rows = []
                    if sum(map(len, sums.values())) > SUMS:
                        yield from given(sums)
                rows.append(row)
        if rows:
            followed(rows, sums)
        yield from given(sums)

    def added(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["h"], r["x"]))
        places = [np.frombuffer(r["h"], "<u4") if r["h"] else np.arange(len(r["x"]) // 8) for r in rows]
        out = np.zeros(max(int(x[-1]) + 1 for x in places))
        for r, place in zip(rows, places, strict=True):
            out[place] += np.frombuffer(r["x"])
        return pa.table({"batch": group.column("batch")[:1], "x": pa.array([out.tobytes()], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        first, *rows = sorted(group.to_pylist(), key=lambda r: (not r["ids"], r["x"]))
        ids, flags, sizes, sums = (unpacked(first[x], kind) for x, kind in (("ids", "<i8"), ("flags", "<u1"), ("sizes", "<u4"), ("c", "<f8")))
        known, base_score = sums.reshape(2, -1)
        scores = np.zeros(len(ids))
        for r in rows:
            x = np.frombuffer(r["x"])
            scores[: len(x)] += x
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=flags >= 2), "held_out": pa.array(flags % 2 == 1), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), n, np.int64)), "base_score": pa.array(base_score), "score": pa.array(scores),
            "perplexity": pa.array(10.0 ** np.minimum(-scores / sizes, 300.0)),
        })

    scored = []
    for turn in range(rounds):
        part = numbered.mapInArrow(sent(turn), sent_schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(follow, "batch string, h binary, x binary")
        scored.append(written(part.groupBy("batch").applyInArrow(added, "batch string, x binary"), "scored"))
    empty = F.lit(b"")
    every_sum = numbered.select("batch", "ids", "flags", "sizes", "c", empty.alias("x"))
    for part in scored:
        every_sum = every_sum.union(part.select("batch", empty, empty, empty, empty, "x"))
    return every_sum.groupBy("batch").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
