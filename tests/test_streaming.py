from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tidewell.streaming import turns as S

LONG = "one two three four five six seven eight nine ten"


def rows(spark, *turns):
    return spark.createDataFrame([(c, t, "user", text, ts) for c, t, text, ts in turns], S.TURN)


def test_batches_in_order(spark, tmp_path):
    g = S.Gateway(spark, f"{tmp_path}/g")
    g.refuse(spark.createDataFrame([("BAD  text",)], "content string"), 0)
    first = rows(spark, ("c", "1", LONG, 10), ("c", "2", "user", 20), ("d", "1", "bad text", 5))
    S.replayed(g, [first, rows(spark, ("c", "2", "user", 20), ("c", "3", LONG, 30), ("c", "0", "late", 15), ("d", "2", "x", 6))])
    before = sorted(map(tuple, g.chunks().collect()))
    assert sorted((r["conversation_id"], r["turn_id"]) for r in g.chunks().collect()) == [("c", "1"), ("c", "2"), ("c", "3"), ("d", "2")]
    assert {r["conversation_id"]: (r["last_turn_id"], r["last_timestamp"]) for r in g.marks().collect()} == {"c": ("3", 30), "d": ("2", 6)}
    g.commit(rows(spark, ("c", "2", "user", 20), ("c", "3", LONG, 30), ("c", "0", "late", 15), ("d", "2", "x", 6)), 1)  # delivered again
    assert sorted(map(tuple, g.chunks().collect())) == before
    g.commit(rows(spark, ("c", "1", LONG, 10)), 2)
    assert sorted(map(tuple, g.chunks().collect())) == before and {r["conversation_id"]: r["last_timestamp"] for r in g.marks().collect()}["c"] == 30


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"conversation_id": "c", "turn_id": str(t), "role": "user", "content": f"text {t}", "timestamp": t}) for t in (i, i + 1)))
        os.utime(tmp_path / f"in/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    g = S.Gateway(spark, f"{tmp_path}/g")
    for _ in range(2):  # the second start finds nothing new
        query = g.start(S.source(spark, f"{tmp_path}/in", 1), f"{tmp_path}/check")
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r["turn_id"] for r in g.chunks().collect()) == ["0", "1", "2", "3"] and g.marks().first()["last_turn_id"] == "3"
    assert json.loads(g.chunks().first()["meta"])["conversation_id"] == "c"


def test_gate(spark):
    chunks = spark.createDataFrame([("c", 1, "a", LONG), ("c", 2, "b", LONG.upper()), ("c", 3, "d", "short"), ("c", 4, "e", LONG + " more words here that differ"), ("x", 1, "f", LONG)], "conversation_id string, timestamp long, chunk_id string, content string")
    got = {r["chunk_id"]: r["verdict"] for r in S.screened(chunks, S.Gate(least_tokens=5, most_tokens=100)).collect()}
    assert got == {"a": "Keep", "b": "Duplicate", "d": "TooShort", "e": "Keep", "f": "Keep"}
    v = spark.range(1).select(S.verdict(F.lit(30), F.lit(0.96)).alias("d"), S.verdict(F.lit(6000), F.lit(0.0)).alias("o"), S.verdict(F.lit(30), F.lit(0.5)).alias("k")).first()
    assert tuple(v) == ("Duplicate", "OverBudget", "Keep")


def run(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name).collect()


def test_windows_dedup_and_promotion(spark, tmp_path):
    for name in ("ev", "refs", "turns"):
        (tmp_path / name).mkdir()
    (tmp_path / "ev/a.json").write_text("\n".join(json.dumps({"k": "u", "ts": f"2024-01-01T00:0{m}:00"}) for m in (0, 1, 7)))
    events = spark.readStream.schema("k string, ts timestamp").json(f"{tmp_path}/ev")
    assert sorted(r["n"] for r in run(S.windows(events, "ts", "5 minutes", keys=("k",)), tmp_path / "w", "complete")) == [1, 2]
    batch = spark.read.schema("k string, ts timestamp").json(f"{tmp_path}/ev")
    assert sorted(r["n"] for r in S.sessions(batch, "ts", "3 minutes", "k").collect()) == [1, 2]
    (tmp_path / "refs/a.json").write_text("\n".join(json.dumps({"id": i, "session_id": s}) for i, s in (("f", "s1"), ("f", "s1"), ("g", "s1"), ("f", "s2"), ("f", "s3"))))
    refs = spark.readStream.schema("id string, session_id string").json(f"{tmp_path}/refs")
    assert [r["id"] for r in run(S.promotions(refs), tmp_path / "p")] == ["f"]
    (tmp_path / "turns/a.json").write_text("\n".join(json.dumps({"conversation_id": "c", "turn_id": t, "role": "u", "content": "x", "timestamp": 1000}) for t in ("1", "1", "2")))
    assert len(run(S.deduplicated(S.source(spark, f"{tmp_path}/turns")), tmp_path / "d")) == 2
    assert [r["position"] for r in S.positions(rows(spark, ("c", "b", "", 2), ("c", "a", "", 1))).orderBy("turn_id").collect()] == [1, 2]
