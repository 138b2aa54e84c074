"""Queries of the consistency index over events, of roll-ups, and of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consistency as C
from .base import STAR, query, read, star

_CUES = "array_to_string(list_sort(list(DISTINCT cue) FILTER (fact_type = '{}')), ',')"


@query(f"WITH {STAR} SELECT story, title, {_CUES.format('purchase')} AS purchase, {_CUES.format('error')} AS error FROM star GROUP BY story, title HAVING bool_or(fact_type = 'purchase') AND bool_or(fact_type = 'error')")
def agg_tension(spark: SparkSession, d: str) -> DataFrame:
    return C.tension(star(spark, d), "purchase", "error")


@query(f"WITH {STAR} SELECT story, title, " + ", ".join(f"{_CUES.format(k)} AS {k}" for k in ("signup", "error", "click", "view", "purchase")) + " FROM star WHERE story = '2024-01-05' GROUP BY story, title")
def agg_fact_pivot(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of one story's facts, side by side for each entity."""
    return C.pivot(star(spark, d).where("story = '2024-01-05'"), ["signup", "error", "click", "view", "purchase"])


@query(f"WITH {STAR}, s AS (SELECT story, title, max((doc_type = 'story-plan')::INT) AS p, max((doc_type = 'draft')::INT) AS d FROM star GROUP BY ALL) SELECT story, sum(p)::BIGINT AS plan_entities, sum(d)::BIGINT AS draft_entities, coalesce(string_agg(title, ',' ORDER BY title) FILTER (p = 1 AND d = 0), '') AS plan_only, coalesce(string_agg(title, ',' ORDER BY title) FILTER (p = 0 AND d = 1), '') AS draft_only FROM s GROUP BY story")
def agg_alignment(spark: SparkSession, d: str) -> DataFrame:
    return C.alignment(star(spark, d), "story-plan", "draft")


@query(f"WITH {STAR}, s AS (SELECT * FROM star), g AS (SELECT title, array_to_string(list_sort(list(DISTINCT name) FILTER (doc_type = 'draft')), ',') AS names_a, array_to_string(list_sort(list(DISTINCT name) FILTER (doc_type = 'story-plan')), ',') AS names_b, count(DISTINCT CASE WHEN doc_type = 'draft' THEN name END) AS n_a FROM s GROUP BY title HAVING bool_or(doc_type = 'draft') AND bool_or(doc_type = 'story-plan')) SELECT * FROM g WHERE names_a <> names_b")
def agg_alias_drift(spark: SparkSession, d: str) -> DataFrame:
    return C.alias_drift(star(spark, d), "draft", "story-plan")


@query(f"WITH {STAR} SELECT count(DISTINCT CASE WHEN doc_type = 'draft' THEN entity_id END) AS draft, count(DISTINCT CASE WHEN doc_type = 'story-plan' THEN entity_id END) AS story_plan, count(DISTINCT CASE WHEN doc_type = 'chapter-plan' THEN entity_id END) AS chapter_plan FROM star")
def agg_support(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.count_distinct(F.when(F.col("doc_type") == k, F.col("entity_id")))
    return star(spark, d).agg(side("draft").alias("draft"), side("story-plan").alias("story_plan"), side("chapter-plan").alias("chapter_plan"))


@query(f"WITH {STAR}, a AS (SELECT DISTINCT story, passage_id, title FROM star) SELECT a.story, a.title AS left, b.title AS right, count(*) AS passages FROM a JOIN a b ON a.story = b.story AND a.passage_id = b.passage_id AND a.title < b.title GROUP BY ALL")
def join_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return C.cooccurrence(star(spark, d))


@query(f"WITH {STAR} SELECT e.c_custkey AS entity_id, c_name AS title, count(s.event_id) AS mentions, coalesce(array_to_string(list_sort(list(DISTINCT s.name) FILTER (s.name IS NOT NULL)), ','), '') AS names FROM customer e LEFT JOIN star s ON s.entity_id = e.c_custkey GROUP BY ALL")
def join_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entities; most have no event."""
    return C.catalog(read(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("title")), star(spark, d))


@query(f"WITH {STAR}, a AS (SELECT story, count(*) AS n FROM star WHERE doc_type = 'draft' AND fact_type = 'error' GROUP BY story), b AS (SELECT story, count(*) AS n FROM star WHERE doc_type = 'story-plan' AND fact_type = 'signup' GROUP BY story), c AS (SELECT story, count(*) AS n FROM star WHERE fact_type = 'purchase' GROUP BY story) SELECT coalesce(a.story, b.story, c.story) AS story, coalesce(a.n, 0) AS errors, coalesce(b.n, 0) AS signups, coalesce(c.n, 0) AS purchases FROM a FULL JOIN b ON a.story = b.story FULL JOIN c ON coalesce(a.story, b.story) = c.story")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Union of the keys of three maps of stories."""
    s = star(spark, d)
    side = lambda w, n: s.where(w).groupBy("story").agg(F.count("*").alias(n))
    j = side("doc_type = 'draft' AND fact_type = 'error'", "errors").join(side("doc_type = 'story-plan' AND fact_type = 'signup'", "signups"), "story", "full").join(side("fact_type = 'purchase'", "purchases"), "story", "full")
    return j.select("story", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "signups", "purchases")])


@query(f"WITH {STAR}, f AS (SELECT entity_id, story, max((fact_type = 'error')::INT) AS e, max((fact_type = 'purchase')::INT) AS p FROM star GROUP BY ALL) SELECT story, sum(e)::BIGINT AS with_error, sum(p)::BIGINT AS with_purchase, sum(e * p)::BIGINT AS with_both, coalesce(string_agg('E' || entity_id, ',' ORDER BY entity_id) FILTER (e = 1 AND p = 1), '') AS names FROM f GROUP BY story")
def agg_two_level(spark: SparkSession, d: str) -> DataFrame:
    f = star(spark, d).groupBy("entity_id", "story").agg(F.max((F.col("fact_type") == "error").cast("int")).alias("e"), F.max((F.col("fact_type") == "purchase").cast("int")).alias("p"))
    ids = F.array_sort(F.collect_list(F.when((F.col("e") == 1) & (F.col("p") == 1), F.col("entity_id"))))
    return f.groupBy("story").agg(F.sum("e").alias("with_error"), F.sum("p").alias("with_purchase"), F.sum(F.col("e") * F.col("p")).alias("with_both"), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("E"), i.cast("string"))), ",").alias("names"))


@query(f"WITH {STAR}, m AS (SELECT *, CASE WHEN coalesce(fact_type <> lag(fact_type) OVER w, true) THEN 1 ELSE 0 END AS new FROM star WINDOW w AS (PARTITION BY entity_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY event_id) AS run FROM m) SELECT entity_id, any_value(fact_type) AS fact_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY entity_id, run HAVING count(*) >= 3")
def win_equal_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.runs(star(spark, d).select("entity_id", "event_id", "fact_type"), "entity_id", "event_id", "fact_type", 3)


@query(f"WITH {STAR}, d AS (SELECT story, count(*) AS n FROM star WHERE fact_type = 'purchase' GROUP BY story), w AS (SELECT story, n, sum(n) OVER x AS total, count(*) OVER x AS days, string_agg(n::VARCHAR, ' -> ') OVER x AS flow FROM d WINDOW x AS (ORDER BY story ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT story, total::BIGINT AS total, flow FROM w WHERE days = 3 ORDER BY total DESC, story LIMIT 3")
def win_rolling(spark: SparkSession, d: str) -> DataFrame:
    """The three best windows of three days, with the flow of their values; days are few, whatever the number of events."""
    n = star(spark, d).where("fact_type = 'purchase'").groupBy("story").agg(F.count("*").alias("n"))
    x = Window.orderBy("story").rowsBetween(-2, 0)
    w = n.select("story", F.sum("n").over(x).alias("total"), F.collect_list(F.col("n").cast("string")).over(x).alias("f")).where(F.size("f") == 3)
    return w.orderBy(F.desc("total"), "story").limit(3).select("story", "total", F.array_join("f", " -> ").alias("flow"))


@query(f"WITH {STAR}, c AS (SELECT story, fact_type, count(*) AS n FROM star GROUP BY ALL), r AS (SELECT *, max(n) OVER (PARTITION BY story) AS top FROM c) SELECT story, CASE WHEN count(*) > 1 THEN 'mixed' ELSE any_value(fact_type) END AS label, any_value(n) AS n FROM r WHERE n = top GROUP BY story")
def sort_label_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label of each story, or mixed where several are."""
    c = star(spark, d).groupBy("story", "fact_type").agg(F.count("*").alias("n"))
    top = c.withColumn("top", F.max("n").over(Window.partitionBy("story"))).where("n = top")
    return top.groupBy("story").agg(F.when(F.count("*") > 1, "mixed").otherwise(F.first("fact_type")).alias("label"), F.first("n").alias("n"))


@query(f"WITH {STAR}, f AS (SELECT story || '::' || entity_id || '::' || fact_type AS conflict_key, story, fact_type, ['accept', 'reject', 'defer'][(event_id % 3 + 1)::INT] AS decision, event_id FROM star), l AS (SELECT conflict_key, any_value(story) AS story, any_value(fact_type) AS fact_type, arg_max(decision, event_id) AS decision FROM f GROUP BY conflict_key) SELECT story, decision, count(*) AS n, count(DISTINCT fact_type) AS kinds FROM l GROUP BY ALL")
def agg_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by story after the last word on each conflict won."""
    decision = F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("defer")), (F.col("event_id") % 3 + 1).cast("int"))
    last = star(spark, d).groupBy("story", "entity_id", "fact_type").agg(F.max_by(decision, "event_id").alias("decision"))
    return last.groupBy("story", "decision").agg(F.count("*").alias("n"), F.count_distinct("fact_type").alias("kinds"))


@query(f"WITH {STAR} SELECT passage_id, count(DISTINCT title) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM star GROUP BY passage_id HAVING count(DISTINCT title) >= 15")
def join_alias_list(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d).groupBy("passage_id").agg(F.count_distinct("title").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return g.where("n >= 15")


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) >= 8)) AS term FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) SELECT item_id, term, count(doc_id) AS docs FROM w LEFT JOIN t USING (term) WHERE term IS NOT NULL GROUP BY ALL""")
def join_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention each long word of an item: containment by an inverted index of tokens."""
    from ..functions import text as T

    w = read(spark, d, "benchmark").select("item_id", F.explode(F.filter(T.token_set(F.col("text")), lambda t: F.char_length(t) >= 8)).alias("term"))
    t = read(spark, d, "documents").select("doc_id", F.explode(T.token_set(F.col("text"))).alias("term"))
    return w.join(t, "term", "left").groupBy("item_id", "term").agg(F.count("doc_id").alias("docs"))


@query("WITH a AS (SELECT l_returnflag AS tier, l_linenumber AS op, avg(l_discount) AS accuracy, avg((l_tax > 0.05)::INT) AS abstain FROM lineitem GROUP BY ALL) SELECT tier, op, round(accuracy, 6) AS accuracy, round(abstain, 6) AS abstain, round(accuracy - lag(accuracy) OVER (PARTITION BY op ORDER BY tier), 6) AS gain FROM a")
def win_marginal_gain(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each tier and kind of question, and the gain over the tier below."""
    a = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tier"), F.col("l_linenumber").alias("op")).agg(F.avg("l_discount").alias("accuracy"), F.avg((F.col("l_tax") > 0.05).cast("int")).alias("abstain"))
    gain = F.col("accuracy") - F.lag("accuracy").over(Window.partitionBy("op").orderBy("tier"))
    return a.select("tier", "op", F.round("accuracy", 6).alias("accuracy"), F.round("abstain", 6).alias("abstain"), F.round(gain, 6).alias("gain"))


@query("WITH q AS (SELECT label, list(vec_id ORDER BY vec_id)[1] AS query FROM embeddings GROUP BY label), s AS (SELECT q.label, e.vec_id, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.label ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM q JOIN embeddings v ON v.vec_id = q.query JOIN embeddings e ON e.vec_id <> q.query) SELECT label, sum(hit::INT)::BIGINT AS hits, round(sum(hit::INT) / 10.0, 4) AS precision_at_10, sum(hit::INT) = 0 AS miss FROM s WHERE r <= 10 GROUP BY label")
def eval_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """A stated query for each label, the least vec_id, against all vectors in one scan."""
    from ..functions import text as T

    e = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    queries = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("q")).agg(F.collect_list(F.struct("label", "q")).alias("all"))
    s = e.select("vec_id", F.col("label").alias("own"), "embedding", F.explode(queries.scalar()).alias("x")).where(F.col("vec_id") != F.col("x.q.vec_id"))
    s = s.select(F.col("x.label").alias("label"), "vec_id", (F.col("own") == F.col("x.label")).cast("long").alias("hit"), T.cosine(F.col("embedding"), F.col("x.q.embedding")).alias("s"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).where("r <= 10")
    found = top.groupBy("label").agg(F.sum("hit").alias("hits"))
    return found.select("label", "hits", F.round(F.col("hits") / 10.0, 4).alias("precision_at_10"), (F.col("hits") == 0).alias("miss"))


@query("SELECT l_shipmode_bucket AS stage, op, count(*) AS calls, round(sum(cost), 4) AS cost, max(cost) AS worst FROM (SELECT l_linestatus AS l_shipmode_bucket, l_returnflag AS op, l_extendedprice AS cost FROM lineitem) GROUP BY ALL")
def agg_metering(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("op")).agg(F.count("*").alias("calls"), F.round(F.sum("l_extendedprice"), 4).alias("cost"), F.max("l_extendedprice").alias("worst"))


@query("SELECT p_brand AS bucket, p_type AS name, sum(p_size)::BIGINT AS total, count(DISTINCT p_partkey % 7) AS stories, string_agg(DISTINCT p_partkey % 3, ',' ORDER BY p_partkey % 3) AS reasons FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey % 7) >= 3")
def agg_catalog_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "part").groupBy(F.col("p_brand").alias("bucket"), F.col("p_type").alias("name")).agg(F.sum("p_size").alias("total"), F.count_distinct(F.col("p_partkey") % 7).alias("stories"), F.array_join(F.array_sort(F.collect_set(F.col("p_partkey") % 3)).cast("array<string>"), ",").alias("reasons"))
    return g.where("stories >= 3")


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) SELECT a.k AS metric, a.n AS baseline, b.n AS applied, b.n - a.n AS change, b.v > a.v AS better FROM a JOIN b USING (k)")
def join_baseline_applied(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    side = lambda s: c.where(F.col("c_mktsegment") == s).groupBy(F.col("c_nationkey").alias("metric")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("v"))
    a, b = side("BUILDING"), side("MACHINERY").select("metric", F.col("n").alias("applied"), F.col("v").alias("v2"))
    return a.join(b, "metric").select("metric", F.col("n").alias("baseline"), "applied", (F.col("applied") - F.col("n")).alias("change"), (F.col("v2") > F.col("v")).alias("better"))
