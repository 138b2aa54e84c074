"""Word and shingle hashing in numpy over whole texts.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only.  Hashes are
64-bit.  Words of up to SHORT bytes: a polynomial over a random byte table,
mixed with the splitmix finaliser; longer ones, for which words with equal
polynomials are known, go through xxh3.  A shingle is a second polynomial over
the hashes of its words.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULT = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240117).integers(1, 2**64, 256, dtype=U64)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
#: Bytes of the words that the polynomial hashes.
SHORT = 32
_POW = np.array([pow(_MULT, i, 1 << 64) for i in range(SHORT)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and offsets: text i has words[off[i]:off[i+1]]."""
    parts, counts = [], np.zeros(len(texts) + 1, np.int64)
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) < _BLOCK):
            size += len(texts[to]) + 1
            to += 1
        h, n = _block(texts[at:to])
        parts.append(h)
        counts[at + 1 : to + 1] = n
        at = to
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(counts)


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return spans(texts)[3:]


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined lower-cased bytes, start, end and hash of each word in them, and how many words each text has."""
    data = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    gap = _SEP[data]
    before = np.empty_like(gap)
    before[0] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(gap & ~before)
    if not len(start):
        return data, start, end, np.zeros(0, U64), np.zeros(len(texts), np.int64)
    size = end - start
    h = _TABLE[data[start]] + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    on = np.flatnonzero(size > 1)
    for i in range(1, SHORT):
        h[on] += _TABLE[data[start[on] + i]] * _POW[i]
        on = on[size[on] > i + 1]
        if not len(on):
            break
    h = mix(h)
    for i in on:
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), 20240117)
    return data, start, end, h, np.diff(np.searchsorted(start, ends_of_text), prepend=0)


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, concatenated, and their offsets.

    A text of fewer than k words has its whole word sequence as one shingle;
    a text without words has the empty set.
    """
    words, off = word_hashes(texts)
    n = np.diff(off)
    rolled = np.zeros(max(0, len(words) - k + 1), U64)
    for j in range(k):
        rolled += words[j : len(words) - k + 1 + j] * U64((0xD1342543DE82EF95 * (2 * j + 1) + j * 0x2545F4914F6CDD1D) % 2**64 | 1) if len(rolled) else U64(0)
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        if n[i] >= k:
            s = np.sort(rolled[off[i] : off[i + 1] - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n[i]:
            s = words[off[i] : off[i + 1]] * (np.arange(3, 3 + 2 * n[i], 2).astype(U64) * U64(0x9FB21C651E98DF25) | U64(1))
            s = mix(s.sum(keepdims=True, dtype=U64) + U64(int(n[i]) * 0x632BE59BD9B4E019 % 2**64))
        else:
            continue
        out.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(sizes)
