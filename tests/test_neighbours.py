from __future__ import annotations

import math

import numpy as np
import pytest

from tidewell.operators import retrieval


def brute(rows, k, threshold):
    """Per id the k best (score, other) over all pairs of its group, sums in the order of the elements."""
    out = {}
    for g, i, v in rows:
        for h, j, w in rows:
            if g != h or i == j or None in (g, i, v, w) or len(v) != len(w) or None in v or None in w or not all(map(math.isfinite, [*v, *w])):
                continue
            dot = n = m = 0.0
            for x, y in zip(v, w, strict=True):
                dot, n, m = dot + x * y, n + x * x, m + y * y
            s = max(-1.0, min(1.0, dot / math.sqrt(n * m))) if n * m > 0 else 0.0
            if s >= threshold:
                out.setdefault(i, []).append((-s, j))
    return {i: [(j, -s) for s, j in sorted(x)[:k]] for i, x in out.items()}


def found(spark, rows, k, threshold, kind="long"):
    df = spark.createDataFrame(rows, f"label int, id {kind}, vector array<double>")
    out = {}
    for r in retrieval.neighbours(df, "label", k, threshold).orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["other"], r["score"]))
    return out


@pytest.mark.parametrize("parts", [(8192, 65536), (20, 50)])
def test_odd_vectors(spark, monkeypatch, parts):
    """Copies, near copies, repeated ids, no direction, NaN, infinite, null and short ones, over one part and over many."""
    monkeypatch.setattr(retrieval, "PART_ROWS", parts)
    monkeypatch.setattr(retrieval, "TILE", 16)
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    r = np.random.default_rng(3)
    rows = [(int(i % 7 == 0), i, r.normal(size=6).tolist()) for i in range(300)]
    rows += [(0, 300 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)] + [(0, 400 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0 + i * 1e-9]) for i in range(60)]
    rows += [(0, 5, rows[9][2]), (0, 5, rows[10][2]), (1, 5, rows[7][2]), (0, 500, [0.0] * 6), (0, 501, [math.nan] + [1.0] * 5), (0, 502, [math.inf] + [1.0] * 5), (0, 503, [None] + [1.0] * 5), (0, 504, None), (None, 505, [1.0] * 6), (0, 506, [1.0] * 5), (0, 507, [1.0] * 5)]
    for threshold in (0.3, -0.5):
        assert found(spark, rows, 5, threshold) == brute(rows, 5, threshold)
    assert found(spark, [], 5, 0.3) == {}


def test_names_as_ids(spark):
    rows = [(1, "b", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (1, "é", [1.0, 0.0]), (2, "c", [1.0, 0.0])]
    assert found(spark, rows, 1, 0.3, "string") == {"a": [("b", 1.0)], "b": [("a", 1.0)], "é": [("a", 1.0)]}


def test_small_groups_stay_whole(spark, monkeypatch):
    """Only a group with more rows than a part has is dealt out, and a row is sent once for each part."""
    monkeypatch.setattr(retrieval, "_best_of_pair", lambda k, threshold: lambda key, table: table.select(["id"]).append_column("other", table["part"].cast("int64")).append_column("score", table["d"].cast("double")))
    monkeypatch.setattr(retrieval, "PART_ROWS", (20, 50))
    df = spark.createDataFrame([(g, 1000 * g + i, [1.0]) for g, n in ((1, 20), (2, 21), (3, 600)) for i in range(n)], "label int, id long, vector array<double>")
    seen = [r["id"] for r in retrieval.neighbours(df, "label", 100, 0.3).collect()]
    assert {i: seen.count(i) for i in (1000, 2000, 3000)} == {1000: 1, 2000: 2, 3000: 12}


def test_large_group(spark):
    """The best of 400 million pairs of one group, with no join of pairs."""
    v = np.random.default_rng(5).normal(size=(20_000, 16)).astype(np.float32)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v.tolist())], "label int, id long, vector array<float>")
    got = retrieval.neighbours(df, "label", 3, 0.3).where("id % 400 = 0").orderBy("id", "rank").select("id", "other").collect()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    for i in range(0, len(v), 400):
        s = unit @ unit[i]
        s[i] = -2
        assert [x["other"] for x in got if x["id"] == i] == np.argsort(-s)[:3].tolist()
