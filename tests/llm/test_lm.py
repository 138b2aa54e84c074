from __future__ import annotations

import math
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import lm
from tidewell.llm.common import scratch_dir

from .conftest import WORD, lower


def tokens(text):
    return [*WORD.findall(lower(text or "")), ""]


def test_base_and_perplexity(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    monkeypatch.setattr(lm, "BUCKET", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(d, t, crc32(str(d).encode()) % 7 == 2) for d, t in docs.select("doc_id", "text").collect()] + [(None, None, False), (5000, "", True), (5001, "never-seen " * 3, None)]
    got = lm.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, held_out boolean, score int")).collect()
    count = Counter(x for _, t, h in rows if not h for x in tokens(t))
    n, v = sum(count.values()), len(count)
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    ours = base = many = 0.0
    for d, t, h in rows:
        r, own = by_id[d], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bool(h), len(own), sum(count[x] > 0 for x in own), n)
        want = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
        if h:
            unknown = [x for x in own if not count[x]]  # the base has no share for their spelling, which the model's probability includes
            ours, base, many = ours + r["score"], base + r["base_score"] - sum(len(x.encode()) + 1 for x in unknown) * math.log10(lm.SYMBOLS), many + len(own)
    assert 10 ** (-ours / many) < 10 ** (-base / many)


def test_contexts_sum_to_one_and_hold_what_follows():
    rng = np.random.default_rng(4)
    root = np.append(np.full(lm.DISHES, 0.5 / lm.DISHES), 0.5)
    singles, pairs = np.zeros((lm.START + 1, lm.DISHES + 1)), np.zeros((lm.PAIRED, lm.PAIRED + 1, lm.DISHES + 1))
    for _ in range(3000):
        u, v, w = rng.integers(lm.START + 1), rng.integers(lm.PAIRED + 1), rng.integers(lm.DISHES + 1)
        singles[u, w] += 1
        if u < lm.PAIRED:
            pairs[u, v, w] += 1
    pairs[5, 6, 7] += 500
    singles[5, 7] += 500
    one, two = lm.seat_contexts(singles, pairs, root)
    for logs in (one.astype(float), two.reshape(-1, lm.DISHES + 1).astype(float)):
        p = 10.0**logs
        p[:, -1] *= root[-1]
        assert np.allclose(p.sum(1), 1, atol=1e-4)
    assert 10 ** two[5, 6, 7] > 0.95 and 10 ** two[5, 9, 7] < 10 ** one[5, 7] * 1.01 and one[5, 7] > one[6, 7] + 1


def test_tokens_and_their_contexts():
    h, first, doc = lm.tokens_of([b"a b", b"", b"b"])
    assert first.tolist() == [True, False, False, True, True, False] and doc.tolist() == [0, 0, 0, 1, 2, 2] and (h[[2, 3, 5]] == lm.END).all() and h[1] == h[4]
    keys = np.sort(np.unique(h))
    contexts = lm.Contexts(keys, np.arange(len(keys)), np.full(len(keys), -1.0))
    dish, one, two = contexts.of(h, first)
    assert one.tolist() == [lm.START, dish[0], dish[1], lm.START, lm.START, dish[4]] and two.tolist() == [lm.PAIRED, lm.PAIRED, dish[0], lm.PAIRED, lm.PAIRED, lm.PAIRED]


def test_beats_the_base_on_texts_of_known_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = [r for r in lm.score(docs.withColumn("held_out", held)).collect() if r["held_out"] and r["n_known"] == r["n_tokens"]]
    print(len(rows), sum(r["n_tokens"] for r in rows), sum(r["score"] for r in rows), sum(r["base_score"] for r in rows))
    assert len(rows) > 10 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in rows)


def test_long_and_repeated_rows(spark, odd_docs):
    got = lm.score(odd_docs.withColumn("held_out", F.lit(False)))
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(np.isfinite(r["score"]) for r in rows)
    assert len({(r["score"], r["base_score"]) for r in rows if r["doc_id"] == 4}) == 1 and sum(r["doc_id"] is None for r in rows) == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 6} == {200_001} and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}


def test_rare_words_after_rare_words(spark):
    """Far beyond the classes and dishes of the driver's restaurants: 3,000 words, each with its own next ones."""
    texts = [(i, " ".join(f"aa{i} bb{i} cc{i}" for _ in range(6)), False) for i in range(3000)]
    asked = [(10_000 + i, f"aa{i} bb{i}", True) for i in range(0, 3000, 7)] + [(20_000 + i, f"aa{i} bb{(i + 1500) % 3000}", True) for i in range(0, 3000, 7)]
    score = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts + asked, "doc_id long, text string, held_out boolean")).collect()}
    assert all(score[10_000 + i] > score[20_000 + i] + 1 for i in range(0, 3000, 7))


def test_two_words_before_tell_what_follows(spark):
    """"x" is followed by the word of what stands before it, which no restaurant of one word knows."""
    texts = [(i, f"p{i % 200} x q{i % 200} end", False) for i in range(4000)]
    asked = [(10_000 + i, f"p{i} x q{i} end", True) for i in range(100, 200)] + [(20_000 + i, f"p{i} x q{i - 100} end", True) for i in range(100, 200)]
    score = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts + asked, "doc_id long, text string, held_out boolean")).collect()}
    assert all(score[10_000 + i] > score[20_000 + i] + 1 for i in range(100, 200))


def test_divided_and_crowded_restaurants_score_everything(spark, monkeypatch):
    monkeypatch.setattr(lm, "MEETING", 300)
    monkeypatch.setattr(lm, "PART", 100)
    monkeypatch.setattr(lm, "HEAD", 50)
    monkeypatch.setattr(lm, "BUCKET", 500)
    texts = [(i, ("the cat of the dog " * (1 + i % 4)) + f"w{i} the the the the", i % 5 == 0) for i in range(200)] + [(900, "the " * 3000, False), (901, "the " * 3000, True)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")
    many = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "CROWD", 1 << 40)
    plain = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    assert len(many) == len(texts) and all(math.isclose(many[k], plain[k], rel_tol=1e-9) for k in plain)
    assert all(np.isfinite(x) and x < 0 for x in many.values()) and many[900] > -3000 * 0.3


def test_words_of_a_restaurant_sum_to_one():
    rng = np.random.default_rng(5)
    m, u, w = (rng.integers(0, k, 6000).astype(np.uint64) for k in (3, 20, 400))
    parent = rng.dirichlet(np.ones(400), 3)
    every = np.array([(a, b, c) for a in range(3) for b in range(25) for c in range(400)], np.uint64).T
    m, u, w = (np.append(x, y) for x, y in zip((m, u, w), every, strict=True))
    learnt = np.append(np.ones(6000), np.zeros(every.shape[1]))
    p = 10.0 ** lm.predicted_words(m, u, w, np.log10(parent)[m.astype(int), w.astype(int)], learnt)
    assert np.allclose(p[6000:].reshape(75, 400).sum(1), 1, atol=1e-9)
    tiny = lm.predicted_words(*(np.zeros(1, np.uint64) for _ in range(3)), np.array([-900.0]), np.zeros(1))
    assert tiny[0] == -900


def test_numbers_come_back_as_packed():
    for kind, x in (("<u4", [0, 3, 70_000, 2**32 - 1]), ("<u4", [0, 0]), ("<u8", [1, 2**64 - 1]), ("<f8", [-0.5, 1e-300]), ("<i8", [-1, 5]), ("<u2", [])):
        assert lm.unpacked(lm.packed(np.array(x, kind)), kind).tolist() == x


def test_what_is_used_up_leaves_the_disk(spark):
    """Tables that stay are less than four times the input; each token once stood there in two, 6 times the input."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    size = lambda top: sum(f.stat().st_size for f in Path(top).rglob("*") if f.is_file())
    shared = scratch_dir(spark).removeprefix("file:")
    before = size(shared)
    scored = lm.score(docs)
    assert size(shared) - before < 4 * Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
    assert scored.count() == docs.count()


def test_spelling_sums_to_one():
    words = [b"the", b"then", b"", b"a", b"zebra"]
    context, symbol, starts = lm.spelled(words)
    state: dict = {}
    for sweep in range(3):
        spelling, state = lm.seat_spelling(context, symbol, np.ones(len(context)), state, sweep)
    assert np.allclose((10.0**spelling.logs.astype(float)).sum(1), 1, atol=1e-4)
    assert spelling.log10([b"the"])[0] > spelling.log10([b"qqq"])[0]


def test_seats_follow_the_restaurant():
    customers, seed = np.full(4000, 200), np.arange(4000).astype(np.uint64)
    drawn = lm.seats(customers, np.full(4000, 2.0), 0.5, seed, 7)
    expected = 1.0
    for k in range(1, 200):
        expected += (2.0) / (2.0 + k - 0.5 * expected)
    assert abs(drawn.mean() - expected) < 0.15 * expected and (drawn >= 1).all() and (drawn <= 200).all()
    assert (lm.seats(customers, np.full(4000, 2.0), 0.5, seed, 7) == drawn).all()


def test_seats_of_many_customers():
    for n, mass, discount in ((20_000, 300.0, 0.6), (3_000, 900.0, 0.1)):
        drawn = lm.seats(np.full(500, n), np.full(500, mass), discount, np.arange(500).astype(np.uint64), 3)
        expected = 1.0
        for k in range(1, n):
            expected += mass / (mass + k - discount * expected)
        assert abs(drawn.mean() - expected) < 0.02 * expected and (drawn <= n).all() and drawn.std() > 1


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).collect() == []
    one = lm.score(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean").withColumn("x", F.lit(1))).collect()
    assert len(one) == 1 and one[0]["train_tokens"] == 0
