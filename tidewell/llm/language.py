"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text (lower-cased in A-Z), white space among
them, in both directions and gives each position probabilities of the
languages; a document pools the mean over all its positions.  Texts of more
than CORE bytes are read in windows: each labels CORE positions of its own and
reads CONTEXT bytes more on either side, so every position is labelled once
and by states that have read so many bytes before and behind it.  Weights are
learnt in numpy by backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bytes_of, pieces, texts_of

#: Units of each direction, positions that a window labels, bytes that it reads on either side of them, and windows read at once.
UNITS, CORE, CONTEXT, AT_ONCE = 16, 480, 32, 2048
#: Bytes of texts that are read together.
TOGETHER = 2 << 20
#: The bounded sample that the network learns from: about so many texts of each language, and so many stretches of so many characters of each text.
SAMPLE_TEXTS, STRETCHES, STRETCH, MOST_LANGUAGES = 300, 16, 64, 256
STEPS, BATCH, RATE = 300, 192, 0.02
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights: rows for each byte, recurrent rows for each unit, of gates z, r and the candidate n, forwards and backwards; output."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray


def windows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """First byte, bytes, first labelled position, position behind the last labelled one, and text of each window of texts between start and end."""
    many = -(-(end - start) // CORE)
    text = np.repeat(np.arange(len(start)), many)
    own = start[text] + CORE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    to = np.minimum(own + CORE, end[text])
    first = np.maximum(own - CONTEXT, start[text])
    return first, np.minimum(to + CONTEXT, end[text]) - first, own - first, to - first, text


def padded(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of size bytes from first, blanks behind them."""
    at = np.arange(int(size.max()) if len(size) else 0)
    rows = data[np.minimum(first[:, None] + at, max(0, len(data) - 1))]
    return np.where(at < size[:, None], rows, np.uint8(32))


def _flip(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each row's first size entries in reverse order."""
    at = size[:, None] - 1 - np.arange(rows.shape[1])
    return np.take_along_axis(rows, np.maximum(at, 0), 1)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    g = h @ u
    k = h.shape[1]
    zr = np.tanh((x[:, : 2 * k] + g[:, : 2 * k]) * 0.5) * 0.5 + 0.5
    z, r, gn = zr[:, :k], zr[:, k:], g[:, 2 * k :]
    n = np.tanh(x[:, 2 * k :] + r * gn)
    return z, r, n, gn, n + z * (h - n)


def _pass(net: Network, way: int, text: np.ndarray, active: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each position, forwards or (way 1) backwards, with what the states of the windows (columns) that have it add to the languages' logits (rows).

    text: the bytes of each position (rows); active: how many windows have it.
    The windows are ordered by falling length, so those that have a position
    are the first ones.  A unit is a row, and the halves of the sigmoids stand
    in the weights, which is exact: each line below works on whole rows.
    """
    k, most = UNITS, text.shape[1]
    half = np.repeat(np.float32([0.5, 0.5, 1.0]), k)[:, None]
    inputs = np.ascontiguousarray(net.inputs[way].T.astype(np.float32) * half)
    recurrent = np.ascontiguousarray(net.recurrent[way].T, np.float32) * np.float32(0.5)
    output = np.ascontiguousarray(net.output[way].T, np.float32)
    h, x_all, g_all = np.zeros((k, most), np.float32), np.empty(3 * k * most, np.float32), np.empty(3 * k * most, np.float32)
    for t in range(len(text)) if not way else reversed(range(len(text))):
        m = active[t]
        x, g, now = x_all[: 3 * k * m].reshape(3 * k, m), g_all[: 3 * k * m].reshape(3 * k, m), h[:, :m]
        np.take(inputs, text[t, :m], 1, out=x, mode="clip")
        np.matmul(recurrent, now, out=g)
        gates, n = g[: 2 * k], g[2 * k :]
        gates += x[: 2 * k]
        np.tanh(gates, out=gates)
        gates += 1  # twice the sigmoid
        n *= gates[k:]
        n += x[2 * k :]
        np.tanh(n, out=n)
        z = gates[:k]
        z *= 0.5
        now -= n
        now *= z
        now += n
        yield t, output @ now


def probabilities(net: Network, data: np.ndarray, first: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The sum over the labelled positions (from low on, below high) of each window's probabilities."""
    out = np.zeros((len(size), len(net.languages)), np.float32)
    bias = np.asarray(net.bias, np.float32)[:, None]
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), AT_ONCE):
        some = order[at : at + AT_ONCE]
        length, starts, ends = size[some], low[some], high[some]
        text = np.ascontiguousarray(padded(data, first[some], length).T)
        active = np.searchsorted(-length, -np.arange(1, len(text) + 1), side="right")
        logits = np.empty((len(text), len(net.languages), len(some)), np.float32)
        for t, y in _pass(net, 0, text, active):
            np.add(y, bias, out=logits[t, :, : active[t]])
        pooled = np.zeros(logits.shape[1:], np.float32)
        for t, p in _pass(net, 1, text, active):
            m = active[t]
            p += logits[t, :, :m]
            p -= p.max(0)
            np.exp(p, out=p)
            p *= ((starts[:m] <= t) & (t < ends[:m])) / p.sum(0)
            pooled[:, :m] += p
        out[some] = pooled.T
    return out


def train(stretches: list[bytes], labels: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Learn from stretches of text and the number of each one's language, by Adam on the cross entropy of all positions."""
    rng = np.random.default_rng(seed)
    k, classes = UNITS, max(1, len(languages))
    params = [rng.normal(0, 0.3, (256, 3 * k)) for _ in (0, 1)] + [rng.normal(0, k**-0.5, (k, 3 * k)) for _ in (0, 1)] + [rng.normal(0, k**-0.5, (k, classes)) for _ in (0, 1)] + [np.zeros(classes)]
    params = [p.astype(np.float32) for p in params]
    if stretches:
        length = np.fromiter(map(len, stretches), np.int64)
        rows = padded(np.frombuffer(b"".join(stretches), np.uint8), np.cumsum(length) - length, length)
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            some = rng.integers(0, len(rows), BATCH)
            grads = _gradients(params, rows[some], length[some], labels[some], classes)
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Network(languages, params[0:2], params[2:4], params[4:6], params[6])


def _gradients(params: list[np.ndarray], rows: np.ndarray, size: np.ndarray, label: np.ndarray, classes: int) -> list[np.ndarray]:
    k, n, longest = UNITS, len(rows), int(size.max())
    on = (np.arange(longest)[:, None] < size).astype(np.float32)
    texts = [rows, _flip(rows, size)]
    tapes, states = [], []
    for way in (0, 1):
        h, tape, out = np.zeros((n, k), np.float32), [], []
        for t in range(longest):
            z, r, c, gn, new = _step(params[way][texts[way][:, t]], h, params[2 + way])
            tape.append((h, z, r, c, gn))
            h = h + on[t][:, None] * (new - h)
            out.append(h)
        tapes.append(tape)
        states.append(np.stack(out))
    at = np.maximum(size - 1 - np.arange(longest)[:, None], 0)
    logits = states[0] @ params[4] + np.take_along_axis(states[1] @ params[5], at[:, :, None], 0) + params[6]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(n), label] -= 1
    p *= (on / on.sum())[:, :, None]
    errors = [p, np.take_along_axis(p, at[:, :, None], 0) * on[:, :, None]]
    grads: list[np.ndarray] = [np.zeros_like(x) for x in params]
    grads[6] = p.sum((0, 1))
    for way in (0, 1):
        grads[4 + way] = np.einsum("tnk,tnc->kc", states[way], errors[way])
        back = errors[way] @ params[4 + way].T
        dh, dx = np.zeros((n, k), np.float32), np.zeros((longest, n, 3 * k), np.float32)
        for t in reversed(range(longest)):
            h, z, r, c, gn = tapes[way][t]
            dh = dh + back[t]
            live = dh * on[t][:, None]
            dc = live * (1 - z) * (1 - c * c)
            dx[t, :, :k] = live * (h - c) * z * (1 - z)
            dx[t, :, k : 2 * k] = dc * gn * r * (1 - r)
            dx[t, :, 2 * k :] = dc
            g = dx[t].copy()
            g[:, 2 * k :] *= r
            grads[2 + way] += h.T @ g
            dh = live * z + g @ params[2 + way].T + dh * (1 - on[t][:, None])
        letters = texts[way][:, :longest].T.reshape(-1)
        order = np.argsort(letters, kind="stable")
        seen, first = np.unique(letters[order], return_index=True)
        grads[way][seen] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], first)
    return grads


def learn(labelled: DataFrame) -> Network:
    """Learn from a bounded sample of the (doc_id, text, lang) of labelled with text and lang.

    Of each of the MOST_LANGUAGES most frequent languages about SAMPLE_TEXTS
    texts go in, chosen by the hash of doc_id, with STRETCHES stretches of
    STRETCH characters each, at hashed places of the whole text; that bounds
    the bytes that reach the driver.  Every language has the same weight.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    number = {x: i for i, x in enumerate(languages)}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (place < int((1 << 30) * min(1.0, SAMPLE_TEXTS / r["n"]))))
    place_of = lambda i: 1 + F.pmod(F.xxhash64("doc_id", i), F.greatest(F.lit(1), F.char_length("text") - STRETCH + 1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substr("text", place_of(i).cast("int"), F.lit(STRETCH)))
    own: dict[str, list[bytes]] = {x: [] for x in languages}
    for row in labelled.where(chosen).select("doc_id", "lang", place.alias("place"), cut.alias("cut")).orderBy("place", "doc_id").limit(2 * SAMPLE_TEXTS * max(1, len(counts))).toLocalIterator():
        own[row["lang"]] += [x for x in (c.encode().lower()[:STRETCH] for c in row["cut"]) if x]
    most = max(map(len, own.values()), default=0)
    stretches, labels = [], []
    for lang, found in own.items():
        if found:
            stretches += (found * -(-most // len(found)))[:most]
            labels += [number[lang]] * most
    return train(stretches, np.array(labels, np.int64), languages)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """docs with lang_pred and score added; columns of these names in docs give way.

    lang_pred is ``und`` and score 0 where text is null or has no letter, or
    where the network knows no language.  Ties go to the language first by
    name.  Repeated rows get equal predictions; an empty table stays empty.
    All bytes of the whole text are read; nothing but the text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in pieces(batches, "text", TOGETHER):
            texts = bytes_of(batch.column("text"))
            places = np.fromiter(map(len, texts), np.int64, len(texts))
            end = np.cumsum(places)
            pooled = np.zeros((batch.num_rows, max(1, len(net.languages))))
            if places.any() and net.languages:
                first, size, low, high, text = windows(end - places, end)
                each = probabilities(net, np.frombuffer(b"".join(texts).lower(), np.uint8), first, size, low, high)
                pooled = np.stack([np.bincount(text, each[:, c], batch.num_rows) for c in range(each.shape[1])], 1)
            known = np.array([bool(net.languages) and bool(_LETTER.search(x)) for x in texts_of(batch.column("text"))], bool) & (places > 0)
            best = pooled.argmax(1)
            score = np.where(known, np.clip(pooled[np.arange(batch.num_rows), best] / np.maximum(places, 1), 0, 1), 0.0)
            names = [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)
