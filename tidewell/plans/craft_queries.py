"""Queries of the craft helpers over conversations, events, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import craft
from .base import TURNS, query, read, turns


@query("SELECT conv_id, turn, (turn + 1) * 500 AS tick, ((turn + 1) * 500) // 1000 AS story, 'story:' || printf('%03d', ((turn + 1) * 500) // 1000) || CASE WHEN ((turn + 1) * 500) % 1000 = 0 THEN '' ELSE '.' || printf('%03d', ((turn + 1) * 500) % 1000) END AS task, CASE WHEN role = 'user' THEN 'turn:' || turn ELSE 'slot-' || conv_id END AS episode FROM conversations")
def fn_story_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Two turns make a beat."""
    tick = (F.call_function("div", craft.position_tick(F.col("turn")), F.lit(2))).cast("long")
    episode = craft.episode_id(F.when(F.col("role") == "user", F.col("turn").cast("string")), F.concat(F.lit("slot-"), F.col("conv_id").cast("string")))
    return read(spark, d, "conversations").select("conv_id", "turn", tick.alias("tick"), craft.story_number(tick).alias("story"), craft.task_id(tick).alias("task"), episode.alias("episode"))


@query(f"WITH {TURNS}, p AS (SELECT *, lag(role) OVER w AS r1, lag(content) OVER w AS c1 FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5((CASE WHEN turn % 2 = 0 THEN 'system:be brief|' ELSE '' END) || (CASE WHEN r1 IS NULL THEN '' ELSE r1 || ':' || c1 || '|' END) || 'user:' || content) AS digest FROM p")
def fn_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a prompt, with the turn before it as history and a system message in every other one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag(F.struct("role", "content")).over(w)
    t = turns(spark, d).withColumn("before", before)
    history = F.when(F.col("before").isNotNull(), F.array("before"))
    said = craft.messages(F.when(F.col("turn") % 2 == 0, F.lit("be brief")), history, F.col("content"))
    return t.select("conv_id", "turn", F.md5(F.concat_ws("|", F.transform(said, lambda m: F.concat(m["role"], F.lit(":"), m["content"])))).alias("digest"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS place FROM c)
SELECT user_id, string_agg(event_type || ' x' || n, ' ' ORDER BY place) AS summary FROM r WHERE place <= 3 GROUP BY user_id""")
def agg_counter_summary(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent event types of each user."""
    return craft.counter_summary(read(spark, d, "events"), ["user_id"], "event_type", "event_id", 3)


_FLOW = "f AS (SELECT user_id, event_id, event_type AS ending, CASE WHEN value < 60 THEN 'none' ELSE 'high' END AS tone, CASE WHEN event_id % 3 = 0 THEN 'warm' ELSE 'neutral' END AS emotion FROM events)"


@query(f"""WITH {_FLOW}, l AS (SELECT *, lead(ending) OVER w AS e2, lead(tone) OVER w AS t2, lead(emotion) OVER w AS m2 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT user_id, event_id * 2 AS place, ending || '+tone:' || tone || ' x2' AS item FROM l WHERE ending = e2 AND tone = t2 AND tone <> 'none' UNION ALL SELECT user_id, event_id * 2 + 1, ending || '+emotion:' || emotion || ' x2' FROM l WHERE ending = e2 AND emotion = m2 AND emotion <> 'neutral'),
g AS (SELECT user_id, item, min(place) AS first FROM i GROUP BY user_id, item), r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place, item FROM g) SELECT * FROM r WHERE place <= 4""")
def win_convergences(spark: SparkSession, d: str) -> DataFrame:
    """Event types as endings, high values as tone, every third event as warm."""
    flow = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("ending"), F.when(F.col("value") < 60, "none").otherwise("high").alias("tone"), F.when(F.col("event_id") % 3 == 0, "warm").otherwise("neutral").alias("emotion"))
    return craft.convergences(flow, ["user_id"], "event_id")


_RANKS = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(craft.BUCKETS)) + " ELSE 99 END"
_CANDIDATES = f"c AS (SELECT p_brand AS brand, p_partkey, p_name AS name, [{', '.join(map(repr, craft.BUCKETS))}, 'other'][p_size % 11 + 1] AS bucket FROM part)"


@query(f"""WITH {_CANDIDATES}, r AS (SELECT *, {_RANKS} AS rank FROM c), g AS (SELECT brand, name, arg_min(bucket, (rank, bucket)) AS bucket, min(rank) AS rank, min(p_partkey) AS first, count(*) AS n FROM r GROUP BY brand, name)
SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY rank, first) AS place, name, bucket, n FROM g""")
def agg_best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates of their brand, buckets by size; all rows are read and all names returned."""
    bucket = F.element_at(F.array(*map(F.lit, [*craft.BUCKETS, "other"])), F.col("p_size") % 11 + 1)
    rows = read(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.col("p_name").alias("name"), bucket.alias("bucket"))
    return craft.best_candidates(rows, ["brand"], "p_partkey", first=None, most=None)


@query("""WITH e AS (SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '::' || user_id ELSE '' END AS key FROM events)
SELECT event_id, split_part(key, '::', 1) AS bucket, CASE WHEN contains(key, '::') THEN split_part(key, '::', 2) ELSE '' END AS name, CASE WHEN event_id % 7 = 0 THEN 'skills/review-guide.md' WHEN event_id % 7 = 1 THEN 'configs/rules/review.yaml#draft.tracked_terms' ELSE 'configs/rules/review.yaml#draft.template_rules' END AS target FROM e""")
def fn_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Event types as buckets and users as names; the number of the event tells the type of candidate."""
    key = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("::"), F.col("user_id").cast("string"))).otherwise(""))
    kind = F.when(F.col("event_id") % 7 == 0, "dialogue").when(F.col("event_id") % 7 == 1, "tracked_term").otherwise("scene_map")
    found = read(spark, d, "events").select("event_id", craft.inferred_candidate(key).alias("c"), kind.alias("kind"))
    return found.select("event_id", "c.bucket", "c.name", craft.deposition_target(F.col("kind")).alias("target"))


@query("""WITH cards AS (SELECT p_partkey AS idx, 'P' || p_partkey AS card_id, p_name || ' ' || p_brand AS title FROM part),
n AS (SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_name || ' ' || p_brand FROM part UNION ALL SELECT 'P' || o_custkey FROM orders) WHERE name <> ''),
e AS (SELECT name, arg_min(card_id, idx) AS card_id FROM n JOIN cards ON title = name OR card_id = name GROUP BY name),
i AS (SELECT name, arg_min(card_id, idx) AS card_id FROM n JOIN cards ON contains(title, name) WHERE name NOT IN (SELECT name FROM e) GROUP BY name) SELECT * FROM e UNION ALL SELECT * FROM i""")
def join_find_cards(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cards; brands, whole titles and the customers' numbers as names."""
    part = read(spark, d, "part")
    title = F.concat("p_name", F.lit(" "), "p_brand")
    cards = part.select(F.col("p_partkey").alias("idx"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("card_id"), title.alias("title"), F.array().cast("array<string>").alias("aliases"))
    names = part.select(F.col("p_brand").alias("name")).union(part.select(title)).union(read(spark, d, "orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string"))))
    return craft.find_cards(names, cards)


@query("SELECT l_orderkey, list_sort(list_distinct(list('p' || l_partkey))) AS entities, list_sort(list_distinct(list('p' || l_partkey || '<SEP>s' || l_suppkey))) AS relations FROM lineitem GROUP BY l_orderkey")
def agg_scope_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, parts as entities, supplies as relations."""
    li = read(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt"))
    return craft.scope_keys(li.withColumnRenamed("src", "name"), li, ("l_orderkey",))


_TRIMMED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS x, unnest(range(len(regexp_split_to_array(text, '\r?\n')))) AS i FROM documents), t AS (SELECT doc_id, i, {_TRIMMED} AS x FROM l),
b AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(x, '^[-*]\s*', ''), '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g') AS x FROM t WHERE x <> '' AND NOT regexp_matches(x, '^#') AND NOT regexp_full_match(x, '[-:| ]+')),
j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS x FROM b WHERE x <> '' GROUP BY doc_id) SELECT doc_id, md5(coalesce(x, '')) AS cleaned FROM documents LEFT JOIN j USING (doc_id)""")
def fn_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(craft.clean_lines(F.col("text"), "^#")).alias("cleaned"))
