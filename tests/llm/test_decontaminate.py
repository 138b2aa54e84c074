from __future__ import annotations

import random

from tidewell.llm import decontaminate
from tidewell.llm.decontaminate import clean, contaminated
from tidewell.llm.shingles import word_hashes

from .conftest import WORD, lower


def brute(docs, items):
    """Pairs with a stretch of one shift where at least 12 words and 0.8 of all agree, by trying every stretch's best sum."""
    out = set()
    for d, text in docs:
        w = WORD.findall(lower(text or ""))
        for i, item in items:
            v = WORD.findall(lower(item or ""))
            for shift in range(-len(v) + 1, len(w)):
                equal = [w[shift + j] == v[j] for j in range(len(v)) if 0 <= shift + j < len(w)]
                best = total = same = most = 0
                for e in equal:
                    if total <= 0:
                        total = same = 0
                    total, same = total + (1 if e else -4), same + e
                    if total > best:
                        best, most = total, same
                if len(v) >= 7 and most >= min(12, len(v)):
                    out.add((d, i))
    return out


def planted(n_docs=40, n_items=9):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([8, 13, 20, 60])))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        text = rng.choices(words, k=80)
        if d % 2:
            own = items[d % n_items][1].split()
            a = rng.randrange(max(1, len(own) - 14))
            part = own[a : a + rng.choice([10, 14, 25])]
            for _ in range(d % 3):
                part[rng.randrange(len(part))] = "OTHER"
            at = rng.randrange(60)
            text[at : at + len(part)] = [x.upper() for x in part]
        docs.append((d, " ".join(text)))
    return docs, items


def test_planted(spark):
    docs, items = planted()
    want = brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(d, b).collect()}
    assert got == want and want
    assert {r["doc_id"] for r in clean(d, b).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(contaminated(d, b).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    assert sorted(contaminated(d, b).collect()) == want


def test_whole_passages_of_the_benchmark_are_found(spark):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = benchmark.selectExpr("item_id as doc_id", "concat('before it ', text, ' after it') as text")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()}
    assert {(i, i) for i, in benchmark.select("item_id").collect()} <= got


def test_odd_rows(spark, odd_docs):
    odd_items = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one two", 1), (None, "x", 1), (4, "lorem ipsum dolor sit amet " * 4, 1)], "item_id long, text string, doc_id long")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(odd_docs, odd_items).collect()} == {(6, 4)}
    assert clean(odd_docs, odd_items).count() == odd_docs.count() - 1
    assert contaminated(odd_docs, odd_items.limit(0)).collect() == [] and clean(odd_docs, odd_items.limit(0)).count() == odd_docs.count()
    assert contaminated(odd_docs.limit(0), odd_items).collect() == []


def brute_whole(docs, items):
    """Pairs with an item, or 12 words or more of it from one agreeing word to another, of which 0.8 agree in one shift."""
    out = set()
    for d, text in docs:
        w = WORD.findall(lower(text or ""))
        for i, item in items:
            v = WORD.findall(lower(item or ""))
            for shift in range(-len(v) + 1, len(w)):
                equal = [w[shift + j] == v[j] for j in range(len(v)) if 0 <= shift + j < len(w)]
                spans = [(a, b) for a in range(len(equal)) for b in range(a + 12, len(equal) + 1) if equal[a] and equal[b - 1]]
                if len(equal) == len(v):
                    spans.append((0, len(v)))
                if any(5 * sum(equal[a:b]) >= 4 * (b - a) for a, b in spans):
                    out.add((d, i))
    return out


def test_substitutions_and_short_items(spark):
    rng = random.Random(12)
    words = [f"t{i}" for i in range(2000)]
    sizes = [1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 16, 20, 25, 30, 60]
    items = [(i, " ".join(rng.sample(words, k=n))) for i, n in enumerate(sizes)]
    docs = []
    for d in range(4 * len(sizes)):
        part = items[d % len(sizes)][1].split()[-30:]
        for at in rng.sample(range(len(part)), k=min(len(part) // 5, d // len(sizes) + 1)):
            part[at] = "OTHER"
        at, text = rng.randrange(20), rng.choices(words, k=20)
        docs.append((d, " ".join([*text[:at], *part, *text[at:]])))
    want = brute_whole(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(d, b, whole=True).collect()}
    assert got == want and len(want) >= len(docs)
    assert {(x, x % len(sizes)) for x, _ in docs} <= got
    assert {r["doc_id"] for r in clean(d, b, whole=True).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_repeated_words_in_bounded_memory(monkeypatch):
    block = decontaminate.Block([1, 2], [b"so " * 300, b"one two three four five six seven eight nine ten eleven twelve"], whole=True)
    texts = [b"so " * 3000 + b"end", b"x one two three four five six seven eight nine ten eleven twelve y", b""]
    whole = decontaminate.overlaps(block, *word_hashes(texts))
    assert [x[:2] for x in whole] == [(0, 0), (1, 1)] and whole[0][4] == 300 and whole[1][2:] == (1, 13, 12)
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    assert decontaminate.overlaps(block, *word_hashes(texts)) == whole
