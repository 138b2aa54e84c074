from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import similarity


def test_following(spark):
    """Against sets of all pairs: bounds of runs, negative and repeated ids, few and many different words, null and short texts."""
    r = random.Random(4)
    words = [f"Wort{i}" for i in range(40)]
    text = lambda n, own: " ".join(r.choice(own) + r.choice(["", ",", "\n"]) for _ in range(n))
    rows = [(i, text(r.choice([0, 4, 5, 60, 60, 60, 60]), words[: r.choice([2, 3, 40])])) for i in [*range(-3, 3), *range(250, 262), 262, 262, 263, 263, 511, 512, 1 << 40]]
    many = [str(i) for i in range(9000)]
    rows += [(700, " ".join(many)), (701, "É " + " ".join(many[1:]) + " É"), (702, "é " + " ".join(many[:5000])), (703, None), (704, "a b c d e"), (None, "a b c d e"), (705, "-- a B c d E f --")]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = [(x["id"], set(x["s"])) for x in df.select("id", T.tokens(F.col("text")).alias("w")).where("id is not null and size(w) >= 5").select("id", T.shingles(F.col("w")).alias("s")).collect()]
    want = sorted((i, len(s & t) / len(s | t)) for i, s in sets for j, t in sets if j == i + 1)
    found = similarity.following(df)
    assert sorted(tuple(x) for x in found.collect()) == want and len(want) > 10
    assert similarity.following(df.limit(0)).collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") + plan.count("LogicalRDD") == 1 and "Join" not in plan
