from __future__ import annotations

import time
from zlib import crc32

import numpy as np

from tidewell.llm import language
from tidewell.llm.queries import op8_language


def test_gradients(monkeypatch):
    monkeypatch.setattr(language, "UNITS", 3)
    rng = np.random.default_rng(0)
    params = [rng.normal(0, 0.5, s) for s in ((256, 9), (256, 9), (3, 9), (3, 9), (3, 2), (3, 2), (2,))]
    size = np.array([3, 2, 4])
    rows = language.padded(np.frombuffer(b"abc de fghi ", np.uint8), np.array([0, 4, 7]), size)
    label = np.array([0, 1, 0])

    def loss():
        net = language.Network(["x", "y"], params[0:2], params[2:4], params[4:6], params[6])
        total = 0.0
        for r, s, y in zip(rows, size, label, strict=True):
            states = []
            for way in (0, 1):
                text, h, out = (r[:s] if not way else r[:s][::-1]), np.zeros((1, 3)), []
                for b in text:
                    h = language._step(net.inputs[way][[b]], h, net.recurrent[way])[-1]
                    out.append(h[0])
                states.append(out if not way else out[::-1])
            for a, b in zip(*states, strict=True):
                z = a @ params[4] + b @ params[5] + params[6]
                total -= z[y] - np.log(np.exp(z).sum())
        return total / size.sum()

    grads = language._gradients(params, rows, size, label, 2)
    for p, g in zip(params, grads, strict=True):
        for at in {tuple(x) for x in np.argwhere(np.abs(g) > 1e-4)[:6].tolist()}:
            old, e = p[at], 1e-5
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 1e-3 * max(1, abs(g[at])) + 1e-4


def by_hand(net, text):
    """Probabilities of each position by one plain pass each way."""
    states = []
    for way in (0, 1):
        h, out = np.zeros((1, net.recurrent[way].shape[0])), []
        for b in text if not way else text[::-1]:
            h = language._step(net.inputs[way][[b]], h, net.recurrent[way])[-1]
            out.append(h[0])
        states.append(out if not way else out[::-1])
    p = np.exp(np.array([a @ net.output[0] + b @ net.output[1] + net.bias for a, b in zip(*states, strict=True)]))
    return p / p.sum(1, keepdims=True)


def test_documents_pool_all_positions(spark):
    rng, k = np.random.default_rng(1), language.UNITS
    net = language.Network(["a", "b", "c"], *[[rng.normal(0, 0.4, s) for _ in (0, 1)] for s in ((256, 3 * k), (k, 3 * k), (k, 3))], rng.normal(0, 0.4, 3))
    texts = ["x", "Two words", "é" * 60, "the quick brown fox " * 11 + "!", "many more words than a window holds, " * 40]
    rows = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        data = text.encode().lower()
        first, size, low, high, _ = language.windows(np.array([0]), np.array([len(data)]))
        assert np.concatenate([np.arange(f + a, f + b) for f, a, b in zip(first, low, high, strict=True)]).tolist() == list(range(len(data)))
        pooled = sum(by_hand(net, data[f : f + n])[a:b].sum(0) for f, n, a, b in zip(first, size, low, high, strict=True)) / len(data)
        assert row["lang_pred"] == net.languages[int(pooled.argmax())] and abs(row["score"] - pooled.max()) < 1e-3
        if len(data) <= language.CORE:
            assert len(first) == 1 and size[0] == len(data)
        else:
            assert np.abs(by_hand(net, data).mean(0) - pooled).max() < 0.01  # what a pass without windows gives


def stepped(net, data, first, size, low, high):
    """Both passes by _step, a window a row, all positions' probabilities at the end."""
    order = np.argsort(-size, kind="stable")
    rows, length = language.padded(data, first[order], size[order]), size[order]
    logits = np.zeros((int(length[0]), len(length), len(net.languages)), np.float32) + net.bias
    for way in (0, 1):
        text, h = rows if not way else language._flip(rows, length), np.zeros((len(length), language.UNITS), np.float32)
        for t in range(int(length[0])):
            m = int((length > t).sum())
            h = language._step(net.inputs[way][text[:m, t]], h[:m], net.recurrent[way])[-1]
            logits[(length[:m] - 1 - t) if way else t, np.arange(m)] += h @ net.output[way]
    p = np.exp(logits - logits.max(2, keepdims=True))
    place = np.arange(len(p))[:, None]
    p *= ((place >= low[order]) & (place < high[order]))[:, :, None] / p.sum(2, keepdims=True)
    out = np.zeros(p.shape[1:])
    out[order] = p.sum(0)
    return out


def test_windows_are_read_as_by_steps_and_quicker():
    rng, k = np.random.default_rng(2), language.UNITS
    net = language.Network(list("abcd"), *[[rng.normal(0, 0.4, s).astype(np.float32) for _ in (0, 1)] for s in ((256, 3 * k), (k, 3 * k), (k, 4))], rng.normal(0, 0.4, 4).astype(np.float32))
    places = np.append(rng.integers(1, 4000, 200), [1, 480, 481, 512])
    data, end = rng.integers(0, 256, places.sum()).astype(np.uint8), np.cumsum(places)
    own = language.windows(end - places, end)[:4]
    assert np.abs(language.probabilities(net, data, *own) - stepped(net, data, *own)).max() < 1e-2
    took = {}
    for f in (stepped, language.probabilities):
        for _ in range(5):
            began = time.process_time()
            f(net, data, *own)
            took[f] = min(took.get(f, 1e9), time.process_time() - began)
    assert took[language.probabilities] < 0.75 * took[stepped], list(took.values())


def test_held_out_accuracy(spark):
    rows = op8_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]
    assert np.mean(judged) > 0.95, np.mean(judged)


def test_odd_rows(spark, odd_docs):
    labelled = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the house is old", "en"), ("das haus ist alt", "de"), (None, "de"), ("x", None)] * 20)], "doc_id long, text string, lang string")
    got = language.identify(odd_docs, language.learn(labelled)).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) and 0 <= r["score"] <= 1
    nothing = language.learn(labelled.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd_docs, nothing).collect()} == {"und"}
    assert language.identify(odd_docs.limit(0), nothing).collect() == []
