from __future__ import annotations

import random

import numpy as np

from tidewell.llm import near_dedup
from tidewell.llm.near_dedup import near_duplicates, merge, plausible, registers
from tidewell.llm.shingles import shingle_sets

from .conftest import shingles


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute(rows)


def planted(seed):
    """Chains of texts that change by a few words, boilerplate that all share, and copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=60)
    rows, n = [], 0
    for _ in range(12):
        text = common + rng.choices(words, k=rng.choice([3, 8, 20, 90]))
        for _ in range(8):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
    return rows


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DENSE", 0)
    rows = planted(1) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  B"), (1005, "b a")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, kept string, n long")
    assert result(near_duplicates(docs)) == brute(rows)


def test_open_buckets(spark):
    rows = planted(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs)) == brute(rows)


def test_lower_similarity(spark):
    rows = planted(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, percent=80)) == brute(rows, 80)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_merge_and_tell_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 900), dtype=np.uint64)
    b[:820] = a[:820]
    x, y = np.sort(a), np.sort(b)
    both = np.unique(np.concatenate((a, b)))
    regs = [registers(v, np.array([0, len(v)])) for v in (x, y, both)]
    assert (merge(regs[0], regs[1]) == regs[2]).all()
    assert plausible(regs[0], regs[1], np.array([900.0]), np.array([900.0]), 0.8).all()
    far = registers(np.sort(rng.integers(0, 2**64, 900, dtype=np.uint64)), np.array([0, 900]))
    assert not plausible(regs[0], far, np.array([900.0]), np.array([900.0]), 0.8).any()


def test_shingles_are_those_of_the_words():
    texts = ["A b\x0bc d e f a b c d e", "x", "", "  ", "Ä b c d e f", "ä b c d e f"]
    values, offsets = shingle_sets([t.encode() for t in texts])
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    assert set(values[offsets[4] : offsets[5]]) != set(values[offsets[5] :])


def test_odd_rows_and_long_words(spark, odd_docs):
    """Nulls, repeated rows, a very long text, and two words that equal polynomials would confuse."""
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and sum(r["doc_id"] is None for r in got) == 1
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[6]["n_shingles"] == 5 and by[4]["component_id"] == 4
    assert all(r["kept"] for r in got) and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 1}
