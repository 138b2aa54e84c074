"""Byte-level BPE encoding and decoding, equal to the tokenizers library.

A long text goes by tree concatenation: it is halved down to leaves, the
leaves are encoded in parallel, and neighbours are joined level by level by
encoding growing windows around each join, until the window begins with
tokens of the left side and ends with tokens of the right side that fix
everything beyond it.  Two facts make that exact.  Between a character that
isn't white space and one that is, or between letters, digits and signs
(after an apostrophe aside), a pre-token ends whatever stands around it; so
beyond such a place inside the agreeing tokens both sides are right.  And in
a stretch of one kind of character, a token sequence is a BPE encoding
exactly if each adjacent pair is one.

Files of other kinds than that are read by the library on whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, texts_of

#: Characters of a leaf; longer texts go by the tree. Tokens of each side that the first window takes. Threads that encode leaves.
LEAF, WINDOW, THREADS = 4096, 8, 2
#: The pre-token pattern of byte-level BPE files; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def kind(c: str) -> str:
    """White space, letter, number, sign, or unknown, as the pre-token pattern sees a character."""
    if c in _BLANK:
        return "s"
    return {"L": "L", "N": "N"}.get(k[0], "o") if (k := unicodedata.category(c)) not in ("Cn", "Co") else "?"


def _fixed(text: str) -> bool:
    """Whether a pre-token ends inside the text whatever stands around it."""
    kinds = [kind(c) for c in text]
    for i in range(1, len(kinds)):
        a, b = kinds[i - 1], kinds[i]
        if a != b and a != "s" and "?" not in (a, b) and (b == "s" or text[i - 1] != "'"):
            return True
    return False


def _library(path: str):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def exact(path: str) -> bool:
    """Whether the file is plain byte-level BPE, which the tree encodes: no other normalizer, pattern or option, and each token encodes to itself."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = plain and (spec.get("decoder") or {}).get("type") == "ByteLevel" and model.get("type", "BPE") == "BPE"
    plain = plain and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in spec.get("added_tokens", []))
    if not plain:
        return False
    alphabet, merged = _byte_alphabet(), ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    whole = [*alphabet, *merged]
    if len(set(whole)) != len(whole) or set(model["vocab"]) - added != set(whole):
        return False
    from tokenizers import Tokenizer

    bare = Tokenizer(_library(path).model)
    return all(len(e.ids) == 1 for i in range(0, len(merged), 4096) for e in bare.encode_batch_fast(merged[i : i + 4096], add_special_tokens=False))


class Codec:
    """Encoder and decoder of a file of the tokenizers library; plain: what exact() says of it."""

    def __init__(self, path: str, plain: bool | None = None) -> None:
        self.plain = exact(path) if plain is None else plain
        self.joins = self.leaves = 0
        if not self.plain:
            self.full = _library(path)
            return
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        order = [*alphabet, *("".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"])]
        self.bytes = [bytes(map(alphabet.__getitem__, t)) for t in order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.core = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes)}, special_tokens={})
        #: The id of each rank; special tokens come after the ranks, in the order of their names.
        self.ids = np.array([*(vocab[t] for t in order), *self.special.values()], np.uint32)
        self.same = bool((self.ids == np.arange(len(self.ids))).all())
        self.rank_of = {c: len(order) + i for i, c in enumerate(self.special)}
        self.bytes += [c.encode() for c in self.special]
        rank = np.zeros(int(self.ids.max()) + 1, np.int64)
        rank[self.ids] = np.arange(len(self.ids))
        sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.sizes, self.starts, self.flat = sizes[rank], (np.cumsum(sizes) - sizes)[rank], np.frombuffer(b"".join(self.bytes), np.uint8)
        self.pool: ThreadPoolExecutor | None = None

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, uint32, and offsets: text i has ids[off[i]:off[i+1]]."""
        if not self.plain:
            rows = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(rows), np.uint32), np.cumsum([0, *map(len, rows)])
        flat, off = array("I"), np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            flat.fromlist(self.encode(text))
            off[i + 1] = len(flat)
        ranks = np.frombuffer(flat, np.uint32)
        return ranks if self.same else self.ids[ranks], off

    def encode(self, text: str) -> list[int]:
        """Ranks of a text of any length: special tokens stand between parts that are encoded alone."""
        parts = self.at_special.split(text) if self.at_special else [text]
        if len(parts) == 1:
            return self.tree(text)
        return [*chain.from_iterable([self.rank_of[p]] if p in self.rank_of else self.tree(p) for p in parts)]

    def tree(self, text: str) -> list[int]:
        """Ranks of a text without special tokens: halves down to leaves, encoded in parallel, then joined level by level."""
        if len(text) <= LEAF:
            return self.core.encode_ordinary(text)
        cuts = [0, len(text)]
        while cuts[1] > LEAF:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        level = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.leaves += len(level)
        self.pool = self.pool or ThreadPoolExecutor(THREADS)
        level = list(self.pool.map(self.core.encode_ordinary, level))
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ranks of both sides' texts together."""
        self.joins += 1
        back = ahead = WINDOW
        while True:
            while back < len(left) and self.bytes[left[-back]][0] & 0xC0 == 0x80:
                back += 1
            while ahead < len(right) and self.bytes[right[ahead]][0] & 0xC0 == 0x80:
                ahead += 1
            a, b = left[-back:], right[:ahead]
            window = self.core.encode_ordinary(self._text(a + b))
            starts, ends = back >= len(left) or self._agree(a, window), ahead >= len(right) or self._agree(b, window, -1)
            if starts and ends:
                return left[:-back] + window + right[ahead:]
            back, ahead = back * (1 if starts else 2), ahead * (1 if ends else 2)

    def _text(self, ranks: list[int], errors: str = "strict") -> str:
        return b"".join(map(self.bytes.__getitem__, ranks)).decode("utf-8", errors)

    def _agree(self, side: list[int], window: list[int], way: int = 1) -> bool:
        """Whether both begin (way 1) or end (way -1) with the same tokens, and those fix what lies beyond them."""
        n, most = 0, min(len(side), len(window))
        at = 0 if way > 0 else -1
        while n < most and side[at + way * n] == window[at + way * n]:
            n += 1
        if n < 2:
            return False
        edge = self._text(side[:2] if way > 0 else side[-2:], "ignore")
        if len({kind(c) for c in edge}) == 1 and kind(edge[0]) != "?":
            return True
        return _fixed(self._text(side[:n] if way > 0 else side[-n:], "ignore"))

    def decode(self, ids: np.ndarray) -> str:
        if not self.plain:
            return self.full.decode(ids.tolist(), skip_special_tokens=False)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str, plain: bool | None = None) -> Codec:
    """The codec of a file, one for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, plain)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of (doc_id, text): the ids of the whole text and the text that they decode to.

    A null or empty text has no ids and decodes to the empty text; an empty
    table gives an empty result; repeated rows give repeated results; more
    columns are ignored.  path: a file of the tokenizers library, readable on
    the driver and on all executors.
    """
    plain = exact(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, plain)
        for batch in pieces(batches, "text"):
            ids, off = tool.encode_batch(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32))),
                "decoded": pa.array([tool.decode(ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.string()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text): encode(), digested before it leaves the worker.

    Nulls, empty texts, empty tables, repeated rows and more columns as in encode().
    """
    plain = exact(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, plain)
        for batch in pieces(batches, "text"):
            ids, off = tool.encode_batch(texts_of(batch.column("text")))
            each = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(off), pa.int64()),
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each],
                "decoded_sha256": [hashlib.sha256(tool.decode(x).encode()).hexdigest() for x in each],
            }, schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
