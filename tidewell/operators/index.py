"""The consistency index: names, mentions and fact cues of entities in passages, and what they say about plans and drafts.

documents (document_id, path, doc_type, story), passages (passage_id,
document_id, text), entities (entity_id, category, title, fields).  facts are
one row for each entity, document and cue: (story, entity_id, title, category,
document_id, doc_type, fact_type, cue).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Cues of each kind of fact, in order; fixed values.
CUES = {
    "injury_negative": ("受伤", "流血", "出血", "伤口", "裂开", "擦伤", "扭伤", "包扎", "咳血", "发白", "发烧", "疼得", "止血贴"),
    "injury_stable": ("没事", "稳住", "恢复", "缓过", "站稳", "止住", "轻伤", "能走", "还能打"),
    "equipment_damaged": ("裂开", "擦痕", "损坏", "失灵", "熄灭", "坏了", "断掉", "烧毁", "暴露体积"),
    "equipment_active": ("展开", "变形", "启动", "亮起", "抬起", "展开快", "护住", "挡在", "接口"),
    "goal_assigned": ("任务", "委托", "命令", "要求", "安排", "交给", "负责"),
    "goal_changed": ("改成", "转而", "临时改", "改口", "换成", "不再是", "目标变成"),
    "goal_completed": ("完成", "办完", "解决", "结束", "交差", "收尾", "达成"),
    "relationship_close": ("信任", "护住", "并肩", "默认", "配合", "接住", "愿意跟", "攥住", "按回去", "摁回去", "扯下来", "拎起来", "认你", "替他扛", "替她扛", "挡在前面", "挡在身前", "拉住", "拉回来", "接应", "护在前面"),
    "relationship_distant": ("提防", "怀疑", "警惕", "疏远", "冷淡", "不信", "避开", "甩开", "推开", "别碰", "闭嘴", "少来", "离远点"),
}
#: Cues of closeness that a negation of trust takes away, and how it is said; fixed values.
NEGATABLE = ("信任", "默认", "配合", "护住", "并肩", "愿意跟", "接住")
NEGATED = r"(不等于|不是|并非|非)\s*信任|信任\s*(不了|不起来|不起|不能)"
SEGMENT = r"[。！？!?；;\n]+"
#: Characters of a name by which it meets passages.
GRAM = 4
#: Bytes between an entity and a cue that belongs to it.
NEAR = 60
ALIAS_FIELD, NO_ALIAS = "别名 / 英文名", ("无", "-", "待定")
PLANS, DRAFTS = ("arc-plan", "story-plan", "chapter-plan"), "drafts"


def title_variants(title: Column) -> Column:
    parts = F.filter(F.transform(F.split(title, "·"), lambda p: T.folded_space(p)), lambda p: p != "")
    return F.when(F.contains(title, F.lit("·")), F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def names(entities: DataFrame) -> DataFrame:
    """(entity_id, title, category, name): the title, its parts around a middle dot, and the aliases of the card."""
    alias = F.coalesce(F.element_at("fields", ALIAS_FIELD), F.lit(""))
    others = F.filter(F.transform(F.split(alias, "[，,、；;]+"), lambda p: T.folded_space(p)), lambda p: p != "")
    own = F.concat(F.array(T.trimmed(F.col("title"))), title_variants(F.col("title")), F.when(~alias.isin("", *NO_ALIAS), others).otherwise(F.array().cast("array<string>")))
    return entities.select("entity_id", "title", "category", F.explode(F.array_distinct(own)).alias("name")).where("name <> ''")


def mentions(passages: DataFrame, named: DataFrame) -> DataFrame:
    """(passage_id, entity_id, name, count) of names that stand in a passage, with how often they do without overlap.

    Passages and names meet by the name's first characters, GRAM of them or
    all it has; a passage has each such gram once, and only grams of lengths
    that names have are made.
    """
    size = F.least(F.char_length("name"), F.lit(GRAM))
    sizes = sorted(r[0] for r in named.select(size).distinct().collect())
    # a lookahead finds all grams in one pass; substring() would count from the start for each
    each = [F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), 1)) for n in sizes]
    at = passages.select("passage_id", "text", F.explode(F.concat(*each) if each else F.array().cast("array<string>")).alias("gram"))
    wanted = named.select("entity_id", "name", F.substring("name", 1, GRAM).alias("gram"))
    found = at.join(wanted, "gram").where(F.contains("text", F.col("name")))
    n = (F.char_length("text") - F.char_length(F.replace(F.col("text"), F.col("name"), F.lit("")))) / F.char_length("name")
    return found.select("passage_id", "entity_id", "name", n.cast("long").alias("count"))


def _place(text: Column, part: Column) -> Column:
    """Bytes before the first place of part in text."""
    return F.octet_length(F.substring_index(text, part, 1))


def segments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SEGMENT), T.trimmed), lambda s: s != "")


def fact_cues(passages: DataFrame, found: DataFrame, cues: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(passage_id, entity_id, name, fact_type, cue): cues in a segment with the name, within NEAR bytes of its first place there."""
    terms = [F.struct(F.lit(k).alias("fact_type"), F.lit(t).alias("cue")) for k, own in (cues or CUES).items() for t in own]
    rows = passages.join(found.select("passage_id", "entity_id", "name"), "passage_id")
    rows = rows.select("passage_id", "entity_id", "name", F.explode(segments(F.col("text"))).alias("s")).where(F.contains("s", F.col("name")))
    rows = rows.select("*", F.explode(F.filter(F.array(*terms), lambda x: F.contains(F.col("s"), x["cue"]))).alias("x"))
    near = F.abs(F.expr("octet_length(substring_index(s, x.cue, 1)) - octet_length(substring_index(s, name, 1))")) <= NEAR
    denied = (F.col("x.fact_type") == "relationship_close") & F.col("x.cue").isin(*NEGATABLE) & F.rlike("s", F.lit(NEGATED))
    return rows.where(near & ~denied).select("passage_id", "entity_id", "name", "x.fact_type", "x.cue").distinct()


def facts(cued: DataFrame, passages: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Cues joined to their documents and entities."""
    docs = documents.select("document_id", "doc_type", "story", "path")
    return cued.join(passages.select("passage_id", "document_id"), "passage_id").join(docs, "document_id").join(entities.select("entity_id", "title", "category"), "entity_id")


def _kinds(rows: DataFrame, kinds: tuple[str, ...], keys: list[str]) -> DataFrame:
    each = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("fact_type") == k, F.col("cue")))), ",").alias(k) for k in kinds]
    return rows.groupBy(*keys).agg(*each)


KEYS = ["story", "entity_id", "title", "category"]


def tensions(rows: DataFrame, kind: str) -> DataFrame:
    """Entities of a story whose drafts hold both sides of a kind: injury, equipment, goal (given and then changed or done) or relationship."""
    sides = {"injury": ("injury_negative", "injury_stable"), "equipment": ("equipment_damaged", "equipment_active"), "goal": ("goal_assigned", "goal_changed", "goal_completed"), "relationship": ("relationship_close", "relationship_distant")}[kind]
    out = _kinds(rows.where(F.col("story").isNotNull()), sides, KEYS)
    second = F.col(sides[1]) != "" if len(sides) == 2 else (F.col(sides[1]) != "") | (F.col(sides[2]) != "")
    return out.where((F.col(sides[0]) != "") & second)


def fact_table(rows: DataFrame, story: str) -> DataFrame:
    """All nine kinds of one story's facts side by side for each entity."""
    return _kinds(rows.where(F.col("story") == story), tuple(CUES), ["title", "category"])


def support(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Documents of drafts, chapter plans and story plans that give facts of the kinds, for each story and entity."""
    of = lambda t: F.count_distinct(F.when(F.col("doc_type") == t, F.col("document_id")))
    return rows.where(F.col("fact_type").isin(kinds)).groupBy("story", "entity_id").agg(of(DRAFTS).alias("draft_docs"), of("chapter-plan").alias("chapter_docs"), of("story-plan").alias("story_docs"))


def fact_confidence() -> Column:
    """From draft_docs, chapter_docs and story_docs."""
    d, c, s = F.col("draft_docs"), F.col("chapter_docs"), F.col("story_docs")
    return F.when((d >= 2) | (d >= 1) & (c + s >= 1), "high").when((d >= 1) | (c >= 1) & (s >= 1), "medium").otherwise("low")


def alias_confidence(plan: Column, draft: Column) -> Column:
    return F.when((plan >= 2) & (draft >= 2), "high").when((plan >= 1) & (draft >= 1), "medium").otherwise("low")


def alignment_confidence(drift: Column) -> Column:
    return F.when(drift >= 3, "high").when(drift >= 2, "medium").otherwise("low")


def mentioned(found: DataFrame, passages: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(story, document_id, path, doc_type, passage_id, entity_id, title, category, name, count) of every mention."""
    return found.join(passages.select("passage_id", "document_id"), "passage_id").join(documents.select("document_id", "path", "doc_type", "story"), "document_id").join(entities.select("entity_id", "title", "category"), "entity_id")


def _side(condition: Column, value: str) -> Column:
    return F.array_sort(F.collect_set(F.when(condition, F.col(value))))


def alignment_gaps(rows: DataFrame, gaps_only: bool = True) -> DataFrame:
    """Entities that only a story's plans or only its drafts name, in two steps: flags for each entity, then sums and lists for each story."""
    flags = rows.where(F.col("story").isNotNull()).groupBy("story", "title").agg(F.max((F.col("doc_type") == "story-plan").cast("int")).alias("p"), F.max((F.col("doc_type") == DRAFTS).cast("int")).alias("d"))
    out = flags.groupBy("story").agg(F.sum("p").alias("plan_entities"), F.sum("d").alias("draft_entities"), _side((F.col("p") == 1) & (F.col("d") == 0), "title").alias("plan_only"), _side((F.col("p") == 0) & (F.col("d") == 1), "title").alias("draft_only"))
    return out.where((F.size("plan_only") > 0) | (F.size("draft_only") > 0)) if gaps_only else out


def alias_drift(rows: DataFrame, by_story: bool = True) -> DataFrame:
    """Entities that plans and drafts both name, but by other names."""
    plan, draft = F.col("doc_type").isin(*PLANS), F.col("doc_type") == DRAFTS
    keys = KEYS if by_story else KEYS[1:]
    out = (rows.where(F.col("story").isNotNull()) if by_story else rows).groupBy(*keys).agg(_side(plan, "name").alias("plan_names"), _side(draft, "name").alias("draft_names"))
    return out.where((F.size("plan_names") > 0) & (F.size("draft_names") > 0) & (F.col("plan_names") != F.col("draft_names")))


def suspects(rows: DataFrame) -> DataFrame:
    """(kind, title, category, path, names, plan_docs, draft_docs): several names in one document, other names in drafts than before, and entities that only plans or only drafts name in two documents or more."""
    none = F.lit(None)
    mixed = rows.where(F.col("doc_type") != "concept").groupBy("entity_id", "title", "category", "path").agg(_side(F.lit(True), "name").alias("names")).where(F.size("names") >= 2)
    a = mixed.select(F.lit("alias_mixing").alias("kind"), "title", "category", "path", "names", none.cast("long").alias("plan_docs"), none.cast("long").alias("draft_docs"))
    drift = alias_drift(rows, by_story=False)
    b = drift.select(F.lit("alias_drift").alias("kind"), "title", "category", none.cast("string").alias("path"), F.concat("draft_names", F.array(F.lit("|")), "plan_names").alias("names"), none.cast("long").alias("plan_docs"), none.cast("long").alias("draft_docs"))
    docs = lambda c: F.count_distinct(F.when(c, F.col("document_id")))
    sides = rows.groupBy("entity_id", "title", "category").agg(docs(F.col("doc_type").isin(*PLANS)).alias("plan_docs"), docs(F.col("doc_type") == DRAFTS).alias("draft_docs"), _side(F.col("doc_type").isin(*PLANS, DRAFTS), "path").alias("paths"))
    kind = F.when((F.col("plan_docs") >= 2) & (F.col("draft_docs") == 0), "plan_only").when((F.col("draft_docs") >= 2) & (F.col("plan_docs") == 0), "draft_only")
    c = sides.select(kind.alias("kind"), "title", "category", none.cast("string").alias("path"), F.slice("paths", 1, 3).alias("names"), "plan_docs", "draft_docs").where("kind IS NOT NULL")
    return a.unionByName(b).unionByName(c)


def conflicts(fact_rows: DataFrame, mention_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(category, story, title, entity_category, summary, confidence), the surest first; those of low confidence go.

    Jumps of injury and equipment, drift of goals, shifts of relationships,
    drift of names, and entities that only plan or draft has.
    """
    out = None
    for kind, category in (("injury", "injury_state_jump"), ("equipment", "equipment_state_jump"), ("goal", "goal_state_drift"), ("relationship", "relationship_tone_shift")):
        rows = tensions(fact_rows, kind)
        kinds = [c for c in rows.columns if c in CUES]
        by = support(fact_rows, kinds)
        if kind in ("injury", "equipment"):
            text = F.concat(F.lit(f"{kind}="), F.col(kinds[0]), F.lit(" -> "), F.col(kinds[1]))
        else:
            text = F.array_join(F.filter(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(k.split("_")[1] + "="), F.col(k))).otherwise("") for k in kinds]), lambda p: p != ""), " ; ")
        one = rows.join(by, ["story", "entity_id"]).select(F.lit(category).alias("category"), "story", "title", F.col("category").alias("entity_category"), text.alias("summary"), fact_confidence().alias("confidence"))
        out = one if out is None else out.unionByName(one)
    a = alias_drift(mention_rows)
    out = out.unionByName(a.select(F.lit("alias_register_drift").alias("category"), "story", "title", F.col("category").alias("entity_category"), F.concat(F.lit("plan="), F.array_join("plan_names", ","), F.lit(" ; draft="), F.array_join("draft_names", ",")).alias("summary"), alias_confidence(F.size("plan_names"), F.size("draft_names")).alias("confidence")))
    g = alignment_gaps(mention_rows)
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{c}="), F.array_join(c, "|"))).otherwise("") for c in ("plan_only", "draft_only")]
    out = out.unionByName(g.select(F.lit("plan_draft_entity_drift").alias("category"), "story", F.lit("-").alias("title"), F.lit("story").alias("entity_category"), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ; ").alias("summary"), alignment_confidence(F.size("plan_only") + F.size("draft_only")).alias("confidence")))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    ordered = out.where("confidence <> 'low'").orderBy(rank, "story", "category", "title")
    return ordered.limit(limit) if limit is not None else ordered


CONFLICT = ("category", "story", "title", "entity_category", "summary")


def with_feedback(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Conflicts with decision, facet and note of the last feedback (by seq) on the same five parts, null where there is none."""
    last = history.groupBy(*CONFLICT).agg(F.max_by(F.struct("decision", "facet", "note"), "seq").alias("f"))
    return rows.join(last, list(CONFLICT), "left").select(*rows.columns, "f.decision", "f.facet", "f.note")


def feedback_counts(rows: DataFrame) -> DataFrame:
    """(counter, name, n) of decided conflicts: by decision, and by category, story and facet with it; undecided ones by story."""
    d = F.col("decision")
    named = F.array(
        F.struct(F.lit("decision").alias("counter"), d.alias("name")), F.struct(F.lit("category").alias("counter"), F.concat_ws("::", "category", d).alias("name")), F.struct(F.lit("story").alias("counter"), F.concat_ws("::", "story", d).alias("name")),
        F.struct(F.lit("facet").alias("counter"), F.when(F.coalesce("facet", F.lit("")) != "", F.concat_ws("::", "facet", d)).alias("name")),
    )
    open_ = F.array(F.struct(F.lit("unresolved").alias("counter"), F.col("story").alias("name")))
    return rows.select(F.explode(F.when(F.coalesce(d, F.lit("")) != "", named).otherwise(open_)).alias("x")).where("x.name IS NOT NULL").groupBy("x.counter", "x.name").agg(F.count("*").alias("n"))


def backlog(history: DataFrame) -> DataFrame:
    """(decision, name, n): the category with most false positives and designed keeps, and the story with most confirmed and watched ones, ties by name."""
    rows = history.select("decision", F.when(F.col("decision").isin("false_positive", "designed_keep"), F.col("category")).when(F.col("decision").isin("confirmed", "watch"), F.col("story")).alias("name")).where("coalesce(name, '') <> ''")
    n = rows.groupBy("decision", "name").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("decision").orderBy(F.desc("n"), "name"))).where("r = 1").drop("r")


def of_story(history: DataFrame, story: str | None) -> DataFrame:
    return history if story is None else history.where(F.col("story") == story)


def decide(rows: DataFrame, category: str, story: str, title: str, decision: str, facet: str = "", note: str = "", at: str = "") -> DataFrame:
    """The feedback row for the one conflict that fits; none or several are an error."""
    fit = rows.where((F.col("category") == category) & (F.col("story") == story) & (F.col("title") == title))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    one = fit.withColumn("__n", n)
    checked = one.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("several conflicts fit")).cast("boolean"))).drop("__n")
    key = F.md5(F.concat_ws("\u0001", *CONFLICT))
    return checked.select(key.alias("conflict_key"), *CONFLICT, F.lit(decision).alias("decision"), F.lit(facet).alias("facet"), F.lit(note).alias("note"), F.lit(at).alias("updated_at"))


def search(passages: DataFrame, documents: DataFrame, query: str, k: int) -> DataFrame:
    """The k passages that have every token of the query, by how often they have them, then path and place."""
    from .recall import T_python_tokens

    wanted = list(dict.fromkeys(T_python_tokens(query)))
    rows = passages.select("passage_id", "document_id", "text", T.tokens(F.col("text")).alias("t"))
    for w in wanted:
        rows = rows.where(F.array_contains("t", w))
    rows = rows if wanted else rows.limit(0)
    scored = rows.withColumn("score", F.size(F.filter("t", lambda x: x.isin(wanted))) / F.size("t")).drop("t")
    return scored.join(documents.select("document_id", "path", "doc_type"), "document_id").orderBy(F.desc("score"), "path", "passage_id").limit(k)


def pairs(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """(story, left, right, segment) of entities whose names stand in one segment of a draft, the lesser title first, each once."""
    named = rows.where(F.col("doc_type") == DRAFTS).select("story", "passage_id", "title", "name").join(passages.select("passage_id", "text"), "passage_id")
    at = named.select("story", "passage_id", "title", "name", F.posexplode(segments(F.col("text"))).alias("i", "segment")).where(F.contains("segment", F.col("name")))
    own = at.groupBy("story", "passage_id", "i", "segment").agg(F.array_sort(F.collect_set("title")).alias("titles")).where(F.size("titles") > 1)
    both = F.expr("flatten(transform(titles, (a, i) -> transform(slice(titles, i + 2, size(titles)), b -> struct(a AS left, b AS right))))")
    return own.select("story", "segment", F.explode(both).alias("p")).select("story", "p.left", "p.right", "segment").distinct()


def canon_conflicts(canon: DataFrame, events: DataFrame) -> DataFrame:
    """Events that deny what the canon says of the same subject, or give another value: canon (canon_id, subject, predicate, negated, value), events (event_id, ...)."""
    e = events.select("event_id", "subject", F.col("predicate").alias("p2"), F.col("negated").alias("n2"), F.col("value").alias("v2"))
    denied = (F.col("predicate") == F.col("p2")) & (F.col("negated") != F.col("n2"))
    other = F.col("value").isNotNull() & F.col("v2").isNotNull() & (F.col("value") != F.col("v2")) & ~F.col("negated") & ~F.col("n2")
    return canon.join(e, "subject").where(denied | other).select("canon_id", "event_id", "subject", F.when(denied, "negation").otherwise("value").alias("kind"))
