from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tidewell.llm import quality

from .conftest import WORD


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    again = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), *[r[c] for c in NAMES]) for r in quality.judge(docs).collect())
    assert got == sorted((-1 if d is None else d, *brute(t)) for d, t in docs.collect())


def js_distance(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += sum(0.5 * x * math.log2(x / m) for x in (a, b) if x > 0)
    return math.sqrt(max(total, 0.0))


def test_distances_are_jensen_shannon(spark):
    text = "The house of the man is in the town and it was old. " * 12 + "A 7 & b" + " Straße" * 3
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    r = next(x for x in quality.REFERENCES if x.name == row["language"])
    kinds = [sum(map(f, text)) for f in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: c.isalpha() and not c.isascii(), lambda c: c in "0123456789", lambda c: c in ".,;:!?'\"()-", lambda c: c in "&")]
    assert abs(row["class_distance"] - js_distance([k / sum(kinds) for k in kinds], r.classes)) < 1e-9
    words = [w.lower() for w in text.split()]
    own = [sum(w == x for w in words) / len(words) for x in r.words]
    assert abs(row["word_distance"] - js_distance([*own, 1 - sum(own)], [*r.words.values(), 1 - sum(r.words.values())])) < 1e-9


def test_prose_stays_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    verdicts = quality.judge(docs)
    passed = verdicts.where(~F.col("base_failed")).agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert passed > 0.9, passed
    junk = spark.createDataFrame([(1, "0x3f 9$ %% 77 {} <> " * 60), (2, " ".join(f"{i}{i}{i}|#" for i in range(200)))], "doc_id long, text string")
    assert [r["kept"] for r in quality.judge(junk).collect()] == [False, False]


def test_native_plan(spark, odd_docs):
    plan = quality.judge(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality.judge(odd_docs.limit(0)).collect() == []


def test_letters_without_common_words_go(spark):
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(5)]
    foreign = " ".join(rng.choice("nie jest oraz przez tego już tylko być który jako ponieważ można wszystkie bardzo także miasto".split()) + rng.choice(["", "m", "ch", "go"]) for _ in range(300))
    rest = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("alo", "erin", "ova", "untel", "isk")]
    prose = [" ".join(rng.choices([*r.words, *rest], weights=[*r.words.values(), *[(1 - sum(r.words.values())) / len(rest)] * len(rest)], k=400)) for r in quality.REFERENCES]
    rows = quality.judge(spark.createDataFrame(list(enumerate([*noise, foreign, *prose])), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["base_failed"] for r in rows] == [False] * 10
    assert [r["kept"] for r in rows] == [False] * 6 + [True] * 4
    assert [r["language"] for r in rows[6:]] == [r.name for r in quality.REFERENCES]


def test_farthest_is_the_distance_without_common_words():
    for r in quality.REFERENCES:
        assert abs(r.farthest - js_distance([0.0] * len(r.words) + [1.0], [*r.words.values(), 1 - sum(r.words.values())])) < 1e-12
