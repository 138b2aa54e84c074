"""Benchmark passages in documents, found by spaced seeds and verified with substitutions allowed.

A spaced seed is a mask of SPAN word positions of which some are ignored.  The
hash of a window's other words is looked up among the hashes of all benchmark
windows; a hit fixes a document, an item and a shift between them.  Around the
hits of a shift the words of both are compared, and a stretch counts where
enough of its words agree.  Benchmarks go to the tasks in blocks of a fixed
number of words, one pass over the documents for each block, and no document
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, pieces
from .shingles import U64, mix, word_hashes

#: Masks over windows of words: 1 counts, 0 is ignored. Each has weight 6; a passage of 13 words with 1 substitution always keeps a window of one of them.
MASKS = ("1110111", "11011011", "1111011", "11111011")
#: With these as well, every stretch of 12 to 27 words of which LEAST_SHARE agree, the outer two among them, keeps a window (all patterns tried).
MORE_MASKS = ("11111",)
#: Words of a benchmark block that goes to the tasks at once.
BLOCK = 1 << 20
#: Hits of one mask that are held at once: a word that a text and an item both repeat makes as many as the product.
HITS = 1 << 20
#: A stretch counts with so many agreeing words at least, or all words of an item that is shorter, and this share of agreement.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
_FACTORS = np.random.default_rng(29).integers(0, 2**64, 16, dtype=U64) | U64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of the words under the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out += words[i : i + n] * _FACTORS[i]
    return mix(out)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing words of the stretch with the largest sum of 1 for each agreeing and -4 for each other word (ties: the first)."""
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))
    low = np.minimum.accumulate(gain[:-1])
    end = int(np.argmax(gain[1:] - low)) + 1
    start = int(np.argmin(gain[:end]))
    return start, end, int(equal[start:end].sum())


def widest_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing words of the widest stretch that starts and ends with an agreeing word and has LEAST_SHARE of them (ties: the first)."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 100, 0) - round(100 * LEAST_SHARE))))
    later = np.maximum.accumulate(gain[at + 1][::-1])[::-1]
    last = np.searchsorted(-later, -gain[at], side="right") - 1
    i = int(np.argmax(at[last] - at))
    return int(at[i]), int(at[last[i]]) + 1, int(last[i]) - i + 1


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of n words: each way of ignoring as many as LEAST_SHARE lets differ."""
    return ["".join("0" if i in out else "1" for i in range(n)) for out in combinations(range(n), n - ceil(round(100 * LEAST_SHARE) * n / 100))]


class Block:
    """Windows of some benchmark items: sorted seed hashes of each mask and where they stand."""

    def __init__(self, ids: list[int], texts: list[bytes], whole: bool = False) -> None:
        self.ids = np.array(ids, np.int64)
        self.words, self.offsets = word_hashes(texts)
        self.tables = []
        self.whole, sizes = whole, np.diff(self.offsets)
        short = [m for n in np.unique(sizes[(sizes > 0) & (sizes < LEAST_WORDS)]).tolist() for m in short_masks(n)] if whole else []
        self.masks = [*MASKS, *(MORE_MASKS if whole else ()), *short]
        for k, mask in enumerate(self.masks):
            h, at = [], []
            for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True):
                if whole and (b - a != len(mask) if k >= len(self.masks) - len(short) else b - a < LEAST_WORDS):
                    continue
                s = seeds(self.words[a:b], mask)
                h.append(s)
                at.append(np.arange(a, a + len(s)))
            h, at = np.concatenate(h) if h else np.zeros(0, U64), np.concatenate(at) if at else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            marks = np.zeros(1 << 16, bool)
            marks[(h >> U64(48)).astype(np.int64)] = True
            self.tables.append((h, at, marks))

    def item(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1


def overlaps(block: Block, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, last word + 1, agreeing words) of the verified stretches, the best of each text and item."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    text_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    shifts: list[np.ndarray] = []
    for mask, (h, places, marks) in zip(block.masks, block.tables, strict=True):
        s = seeds(words, mask)
        at = np.flatnonzero(marks[(s >> U64(48)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(h, s[at]), np.searchsorted(h, s[at], side="right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        until = np.cumsum(n)
        for a, b in pairwise(np.unique(np.concatenate(([0], np.searchsorted(until, np.arange(HITS, int(n.sum()), HITS)), [len(n)]))).tolist()):
            m = n[a:b]
            which = np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            where, place = np.repeat(at[a:b], m), places[which]
            same = text_of(where) == text_of(where + len(mask) - 1)
            where, place = where[same], place[same]
            item = block.item(place)
            shifts.append(np.unique(np.stack((text_of(where), item, where - (place - block.offsets[item])), 1), axis=0))
    if not shifts:
        return []
    for text, item, shift in np.unique(np.concatenate(shifts), axis=0).tolist():
        own = block.words[block.offsets[item] : block.offsets[item + 1]]
        first, last = max(shift, int(offsets[text])), min(shift + len(own), int(offsets[text + 1]))
        equal = words[first:last] == own[first - shift : last - shift]
        if block.whole:
            start, end, same_words = widest_stretch(equal)
            if len(equal) == len(own) and 100 * equal.sum() >= round(100 * LEAST_SHARE) * len(own):
                start, end, same_words = 0, len(own), int(equal.sum())
            enough = end - start >= min(LEAST_WORDS, len(own))
        else:
            start, end, same_words = best_stretch(equal)
            enough = same_words >= min(LEAST_WORDS, len(own)) and same_words >= LEAST_SHARE * (end - start)
        if enough:
            best = found.get((text, item))
            if best is None or same_words > best[2]:
                base = int(offsets[text])
                found[text, item] = (first + start - base, first + end - base, same_words)
    return [(t, i, *x) for (t, i), x in sorted(found.items())]


def _blocks(benchmark: DataFrame, whole: bool) -> Iterator[Block]:
    """The items with words, by id, in blocks of BLOCK words and one item at least."""
    ids, texts, size = [], [], 0
    for row in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1].encode())
        size += len(texts[-1]) // 2 + 1
        if size >= BLOCK:
            yield Block(ids, texts, whole)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, item_id, first_word, end_word, same_words, item_words: the best overlap of each document and item that share one.

    docs: doc_id, text; benchmark: item_id, text; more columns are ignored,
    whatever their names.  Words as in the shingles, so case in A-Z doesn't
    count.  An overlap has LEAST_WORDS agreeing words at least (an item of fewer
    words: all of them, and 7 so that a seed fits) and LEAST_SHARE agreeing
    words in its stretch.  whole: instead, an overlap is the widest stretch
    between two agreeing words that spans LEAST_WORDS, or an item taken whole,
    of any length, with LEAST_SHARE agreeing words.  Null and empty texts overlap with nothing; of equal
    overlaps the first counts; repeated documents or items give a row each; an
    empty table gives none.
    """
    found = None
    for block in _blocks(benchmark, whole):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            sizes = np.diff(block.offsets)
            for batch in pieces(batches, "text"):
                ids = batch.column("doc_id")
                rows = overlaps(block, *word_hashes(bytes_of(batch.column("text"))))
                if rows:
                    text, item, first, end, same = (np.array(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(text)), "item_id": block.ids[item], "first_word": pa.array(first, pa.int64()), "end_word": pa.array(end, pa.int64()), "same_words": pa.array(same, pa.int64()), "item_words": pa.array(sizes[item], pa.int64())})

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word long, end_word long, same_words long, item_words long")
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, end_word long, same_words long, item_words long")


def clean(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of docs that overlap with no item (whole: as in contaminated); all columns stay, no row is shuffled, and null texts stay."""
    for block in _blocks(benchmark, whole):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                stays = np.ones(batch.num_rows, bool)
                stays[[row[0] for row in overlaps(shared.value, *word_hashes(bytes_of(batch.column("text"))))]] = False
                if stays.any():
                    yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
