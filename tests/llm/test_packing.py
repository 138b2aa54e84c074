from __future__ import annotations

import numpy as np

from tidewell.llm import packing
from tidewell.llm.packing import Plan, pack, write_packed


def plain_best_fit(sizes, capacity):
    free, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            r = len(free) - 1 - free[::-1].index(min(fits))
            rows[r].append(i)
            free[r] -= sizes[i]
        else:
            rows.append([i])
            free.append(capacity - sizes[i])
    return rows


def planned(sizes, capacity):
    """Rows of piece numbers, and where each piece stands."""
    plan, numbers, seen = Plan(dict(zip(*np.unique(sizes, return_counts=True), strict=True)), capacity), [], {}
    for s in sizes.tolist():
        numbers.append(seen.get(s, 0))
        seen[s] = numbers[-1] + 1
    row, place = plan.place(sizes, np.array(numbers))
    return [np.flatnonzero(row == r) for r in range(plan.rows)], place


def test_as_full_as_a_plain_search():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64, 100):
        for n in (0, 1, 300):
            sizes = rng.integers(1, capacity + 1, n)
            if n:
                sizes[: n // 3] = sizes[0]  # a third of all pieces has one length
            rows, place = planned(sizes, capacity)
            assert sorted(i for r in rows for i in r) == list(range(n))
            for r in rows:
                order = r[np.argsort(place[r])]
                assert place[order].tolist() == (np.cumsum(sizes[order]) - sizes[order]).tolist() and sizes[r].sum() <= capacity
            assert sorted(int(sizes[r].sum()) for r in rows) == sorted(int(sizes[r].sum()) for r in plain_best_fit(sizes.tolist(), capacity))


def test_plan_is_small_for_many_pieces():
    rng = np.random.default_rng(2)
    plan = Plan({s: int(c) for s, c in enumerate(rng.integers(0, 10**10, 2049)) if s}, 2048)
    assert sum(map(len, plan.segments.values())) < 40_000


def unpacked(rows, capacity):
    docs = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == capacity and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 0).all()
        assert r["position_resets"] == r["cu_seqlens"][:-1] and r["n_segments"] == len(r["doc_ids"])
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            docs.setdefault(doc, []).append((start, ids[a:b].tolist()))
    return docs


def test_lossless(spark, vocabulary, monkeypatch, tmp_path, odd_docs):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 16)
    tool = Tokenizer.from_file(vocabulary)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    write_packed(pack(docs, vocabulary, capacity=128, end_id=50256), f"{tmp_path}/packed")
    got = unpacked(spark.read.parquet(f"{tmp_path}/packed").collect(), 128)
    for doc, text in docs.collect():
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 50256]
        parts = sorted(got[doc])
        assert [x for _, part in parts for x in part] == ids and [s for s, _ in parts] == list(range(0, len(ids), 128))
    sizes = np.array([len(p) for parts in got.values() for _, p in parts])
    fill = sorted(r["n_tokens"] for r in spark.read.parquet(f"{tmp_path}/packed").select("n_tokens").collect())
    assert fill == sorted(int(sizes[r].sum()) for r in plain_best_fit(sizes.tolist(), 128))
    with monkeypatch.context() as m:
        m.setattr(packing, "BROADCAST", 0)
        assert fill == sorted(r["n_tokens"] for r in pack(docs.repartition(3), vocabulary, capacity=128, end_id=50256).collect())
    odd = unpacked(pack(odd_docs, vocabulary, capacity=64, end_id=50256).collect(), 64)
    assert odd[1] == [(0, [50256])] and sorted(odd[4]) == [(0, [*tool.encode("one two").ids, 50256])] * 2 and None in odd
    assert 1 not in unpacked(pack(odd_docs, vocabulary, capacity=64).collect(), 64)
    assert pack(docs.limit(0), vocabulary).collect() == []
