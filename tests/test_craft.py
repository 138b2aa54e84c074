from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import audit, craft


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def text(x):
    return F.lit(x).cast("string")


def test_story_time(spark):
    ticks = [craft.task_id(F.lit(t)) for t in (1000, 1500, 2000, 12_000, 1_234_005)]
    assert values(spark, *ticks) == ("story:001", "story:001.500", "story:002", "story:012", "story:1234.005")
    assert values(spark, craft.position_tick(F.lit(0)), craft.position_tick(F.lit(1)), craft.story_number(F.lit(2999))) == (1000, 2000, 2)
    assert values(spark, craft.episode_id(text("7"), text("k")), craft.episode_id(text(None), text("k"))) == ("turn:7", "k")


def test_scopes(spark):
    one, whole = values(spark, *craft.scopes(text("w"), text("s"), text(None)))
    assert (tuple(one), tuple(whole)) == (("w", "s", ""), ("w", "", ""))


def test_messages_and_rows(spark):
    history = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("hm").alias("content")))
    said, bare = values(spark, craft.messages(text("sys"), history, text("q")), craft.messages(text(None), F.lit(None), text("q")))
    assert [tuple(m) for m in said] == [("system", "sys"), ("assistant", "hm"), ("user", "q")] and [tuple(m) for m in bare] == [("user", "q")]
    assert values(spark, craft.arm_text(F.array(F.lit("a"), F.lit("b")))) == ("a, b",)
    rows = craft.plain_vector_rows(spark.createDataFrame([("A", "b"), ("A", None)], "name string, description string")).collect()
    assert [(r["content"], r["id"][:4]) for r in rows] == [("Ab", "ent-"), ("A", "ent-")]


def test_cards(spark):
    cards = spark.createDataFrame([(0, "c0", "Old Tower of Ash", ["Tower"]), (1, "c1", "Tower", None), (2, "c2", "Ash", ["c1"]), (3, "c3", None, None)], "idx int, card_id string, title string, aliases array<string>")
    wanted = spark.createDataFrame([("Tower",), ("Ash",), ("c1",), ("of",), ("none",), ("",), (None,), ("Ash",)], "name string")
    assert {r["name"]: r["card_id"] for r in craft.find_cards(wanted, cards).collect()} == {"Tower": "c0", "Ash": "c2", "c1": "c1", "of": "c0"}
    assert craft.find_cards(wanted.limit(0), cards).collect() == []


def test_cards_with_common_beginnings(spark):
    """Names and titles that begin alike are no pairs to try, and equal titles stand for their first card."""
    cards = spark.range(20_000).select(F.col("id").alias("idx"), F.concat(F.lit("c"), F.col("id")).alias("card_id"), F.concat(F.lit("The Tower "), F.lpad((F.col("id") % 15_000).cast("string"), 5, "0"), F.lit("!")).alias("title"), F.lit(None).cast("array<string>").alias("aliases"))
    wanted = spark.range(20_000).select(F.concat(F.lit("The Tower "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"))
    found = craft.find_cards(wanted, cards)
    assert {r["name"]: r["card_id"] for r in found.collect()} == {f"The Tower {i:05}": f"c{i}" for i in range(15_000)}
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_cards_with_wide_characters(spark):
    cards = spark.createDataFrame([(1, "c1", "x😀y😀", ["a\nb", "?z"]), (2, "c2", "😀z", None)], "idx int, card_id string, title string, aliases array<string>")
    wanted = spark.createDataFrame([(x,) for x in ("😀y", "y😀", "😀", "\nb", "z", "?y", "?", "x😀y😀", "x😀y😀x")], "name string")
    assert {r["name"]: r["card_id"] for r in craft.find_cards(wanted, cards).collect()} == {"😀y": "c1", "y😀": "c1", "😀": "c1", "\nb": "c1", "z": "c1", "?": "c1", "x😀y😀": "c1"}


def test_lines_and_dialogue(spark):
    raw = "# head\n\n- a `b`\n | --- | \n  * x **c** d \r\n- "
    assert values(spark, craft.clean_lines(text(raw), "^#"), craft.clean_lines(text(None), "^#")) == ("a b\nx c d", "")
    lead = lambda p: craft.dialogue_lead(text(p), audit.quote_ratio(text(p)))
    assert values(spark, lead("“走。”\n“好。”"), lead("他说：“走。”"), lead("他走了。"), lead(" \n "), lead("“走。”\n他走了。")) == ("“走。”", "他说：“走。”", None, None, None)


def test_roles_and_counters(spark):
    rows = spark.createDataFrame([(1, "动作", 1), (1, "对白", 2), (1, "动作", 3), (1, "对白", 4), (1, "?", 5), (2, None, 1)], "doc_id int, role string, at int")
    first = craft.role_counts(rows.where("role is not null")).first()
    assert [tuple(x) for x in first["roles"]] == [("对白", 2), ("动作", 2), ("?", 1)] and first["top_role"] == "对白"
    assert {r["doc_id"]: r["summary"] for r in craft.counter_summary(rows, ["doc_id"], "role", "at", 2).collect()} == {1: "动作 x2 对白 x2", 2: "无"}


def test_convergences(spark):
    flow = spark.createDataFrame([(1, i, *x) for i, x in enumerate([("hook", "dark", "neutral"), ("hook", "dark", "neutral"), ("hook", "none", "sad"), ("hook", "none", "sad"), ("calm", "none", "sad"), ("hook", "dark", "x"), ("hook", "dark", "y")])], "story int, at int, ending string, tone string, emotion string")
    assert [r["item"] for r in craft.convergences(flow, ["story"], "at").orderBy("place").collect()] == ["hook+tone:dark x2", "hook+emotion:sad x2"]


def test_candidates(spark):
    rows = spark.createDataFrame([(1, 0, "a", "tokens"), (1, 1, "b", "zzz"), (1, 2, "a", "patterns"), (1, 3, "c", "tokens"), (1, 4, "d", "tokens")], "k int, at int, name string, bucket string")
    assert [(r["name"], r["bucket"], r["n"]) for r in craft.best_candidates(rows, ["k"], "at").orderBy("place").collect()] == [("a", "patterns", 2), ("c", "tokens", 1), ("d", "tokens", 1), ("b", "zzz", 1)]
    assert [r["name"] for r in craft.best_candidates(rows, ["k"], "at", first=2, most=1).collect()] == ["a"]
    whole, bare, term = values(spark, craft.inferred_candidate(text("x::y::z")), craft.inferred_candidate(text("x")), craft.inferred_candidate(text("x::y"), True))
    assert (whole[:2], bare[:2], term[:2]) == (("x", "y::z"), ("x", ""), ("learned_filter", "y"))
    assert values(spark, *[craft.deposition_target(text(x)) for x in ("ending", "learned_filter", "else", None)]) == (craft.ENDING_TARGET, craft.TERM_TARGET, craft.TEMPLATE_TARGET, craft.TEMPLATE_TARGET)


@pytest.mark.parametrize(("row", "bonus"), [((1, 1, 0), [craft.KEPT_BONUS, craft.DONE_BONUS]), ((0, 1, 2), []), ((0, 0, 0), [])])
def test_bonus(spark, row, bonus):
    assert craft.consistency_bonus(spark.createDataFrame([row], "designed_keep int, false_positive int, pending int")).first()["bonus"] == bonus


def test_repeated_ids(spark):
    assert {r["id"]: r["n"] for r in craft.repeated_ids(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")).collect()} == {"a": 2, "": 1}
