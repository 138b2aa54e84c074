"""Helpers of the craft memories: story time, scopes, cards, candidates, convergences and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T

#: Fixed value: ticks of one story beat.
TICK_SCALE = 1000
#: Labels that make no run or convergence, the text of an empty counter.
WEAK_TONE, WEAK_EMOTION, NO_COUNT = "none", "neutral", "无"
#: The rule of a table (a whole line), a bullet, marks of code and of bold text.
TABLE_LINE, BULLET, BACKTICKS, BOLD = r"[-:| ]+", r"^[-*]\s*", r"`([^`]+)`", r"\*\*([^*]+)\*\*"
#: Names of what feedback on consistency earns.
KEPT_BONUS, DONE_BONUS = "一致性例外已沉淀", "一致性复核收敛"
#: Buckets of candidates, the most urgent first; all others rank UNKNOWN_BUCKET.
BUCKETS = ("patterns", "custom_template", "phrases", "tokens", "punctuation", "sentence_length", "fatigue_window", "ba_operation_context", "tracked_term", "learned_filter")
UNKNOWN_BUCKET = 99
#: Roles of short sentences in the order of their report.
ROLES = ("对白", "动作", "信息", "判断", "情绪", "清单", "其他")
#: Where candidates of a type go; all others go to the template rules.
TERM_TARGET, TEMPLATE_TARGET, GUIDE_TARGET, ENDING_TARGET = "configs/rules/review.yaml#draft.tracked_terms", "configs/rules/review.yaml#draft.template_rules", "skills/review-guide.md", "novel1/rules/draft.md"
TARGETS = {
    "dialogue": GUIDE_TARGET, "dialogue_axis_gap": GUIDE_TARGET, "dialogue_emotion": GUIDE_TARGET,
    "tracked_term": TERM_TARGET, "tracked_term_window": TERM_TARGET, "learned_filter": TERM_TARGET, "ending": ENDING_TARGET,
}


def episode_id(turn_id: Column, key: Column) -> Column:
    """``turn:`` and the turn's id, or the slot key of an episode without a turn."""
    return F.coalesce(F.concat(F.lit("turn:"), turn_id), key)


def position_tick(position: Column) -> Column:
    """The tick of the event at a position of a transcript, counted from 0: one beat each."""
    return (position + 1) * TICK_SCALE


def story_number(tick: Column) -> Column:
    return F.call_function("div", tick, F.lit(TICK_SCALE))


def padded_tick(tick: Column) -> Column:
    """Beats in three digits or more, and three digits behind a dot where the tick isn't whole; sorts as the ticks do up to beat 999."""
    beat, rest = story_number(tick), tick % TICK_SCALE
    # lpad cuts what is longer
    digits = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(3), F.char_length(c.cast("string"))), F.lit("0"))
    return F.concat(digits(beat), F.when(rest != 0, F.concat(F.lit("."), digits(rest))).otherwise(F.lit("")))


def task_id(tick: Column) -> Column:
    return F.concat(F.lit("story:"), padded_tick(tick))


def scopes(workspace: Column, session: Column, task: Column | None = None) -> tuple[Column, Column]:
    """(ws, sess, task) structs of one session and of all sessions of the workspace; absent parts are empty strings."""
    task = F.coalesce(task, F.lit("")) if task is not None else F.lit("")
    key = lambda s: F.struct(workspace.alias("ws"), s.alias("sess"), task.alias("task"))
    return key(F.coalesce(session, F.lit(""))), key(F.lit(""))


def scope_keys(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, entities, relations: sorted distinct names of nodes (name) and relation keys of edges (src, tgt) of each document."""
    of_nodes = nodes.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("entities"))
    of_edges = edges.groupBy(*keys).agg(F.array_sort(F.collect_set(R.relation_key(F.col("src"), F.col("tgt")))).alias("relations"))
    empty = F.array().cast("array<string>")
    return of_nodes.join(of_edges, list(keys), "full").select(*keys, F.coalesce("entities", empty).alias("entities"), F.coalesce("relations", empty).alias("relations"))


def plain_vector_rows(nodes: DataFrame) -> DataFrame:
    """id, content, entity_name of (name, description): the older layout, without a line break between the two."""
    name = F.coalesce("name", F.lit(""))
    return nodes.select(R.vector_id("ent-", name).alias("id"), F.concat(name, F.coalesce("description", F.lit(""))).alias("content"), name.alias("entity_name"))


def messages(system: Column, history: Column, prompt: Column) -> Column:
    """Array of (role, content): the system's where there is one, the history, the user's prompt."""
    said = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.when(system.isNotNull(), said("system", system)).otherwise(none), F.coalesce(history, none), said("user", prompt))


def arm_text(keywords: Column) -> Column:
    """The text that an arm searches for."""
    return F.concat_ws(", ", keywords)


def _runs(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of so many characters; none starts within a surrogate pair."""
    each = [F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=([^\uDC00-\uDFFF].{{{n - 1}}}))"), 1)) for n in sizes]
    return F.concat(*each) if each else F.array().cast("array<string>")


def find_cards(wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """name, card_id of each distinct non-empty name of wanted and the first card (by idx) that it means; names without one are left out.

    cards: idx, card_id, title, aliases.  A card whose title, id or alias is
    the name comes first, then one whose title or alias contains it.  Equal
    titles and aliases count once, for their first card; names that no card
    is are met whole by the labels' runs of as many characters, each for its
    first card, so no pairs of names and labels are tried.
    """
    names = wanted.where("name <> ''").select("name").distinct()
    cards = cards.withColumn("card", F.struct("idx", "card_id"))
    labels = cards.select("card", F.explode(F.concat(F.array(F.col("title")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    labels = labels.groupBy("name").agg(F.min("card").alias("card"))
    known = labels.union(cards.select(F.col("card_id").alias("name"), "card")).groupBy("name").agg(F.min("card").alias("card"))
    met = names.join(known, "name", "left")
    left = met.where("card IS NULL").select("name")
    sizes = sorted(r[0] for r in left.select(F.char_length("name")).distinct().collect())
    runs = labels.select("card", F.explode(_runs(F.col("name"), sizes)).alias("name")).groupBy("name").agg(F.min("card").alias("card"))
    return met.where("card IS NOT NULL").select("name", "card.card_id").union(left.join(runs, "name").select("name", "card.card_id"))


def clean_lines(text: Column, noise: str, table: str = TABLE_LINE, bullet: str = BULLET, code: str = BACKTICKS, bold: str = BOLD) -> Column:
    """text without blank lines, lines that noise finds and rules of tables; bullets, back ticks and stars go from the rest."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), T.trimmed)
    lines = F.filter(lines, lambda x: (x != "") & ~F.rlike(x, F.lit(noise)) & ~F.rlike(x, F.lit(rf"\A(?:{table})\z")))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, bullet, ""), code, "$1"), bold, "$1"))
    return F.concat_ws("\n", F.filter(bare, lambda x: x != ""))


def is_quote_line(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*[“\"【]"))


def dialogue_lead(paragraph: Column, ratio: Column) -> Column:
    """The first line of a paragraph of dialogue, null for others: every line starts with a quote, or one line has one and more than 0.02 of it (ratio) is quoted."""
    lines = F.filter(F.transform(F.split(paragraph, "\r?\n"), T.trimmed), lambda x: x != "")
    single = (F.size(lines) == 1) & (ratio > 0.02) & F.contains(F.get(lines, 0), F.lit("“"))
    return F.when((F.size(lines) > 0) & (F.forall(lines, is_quote_line) | single), F.get(lines, 0))


def role_counts(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, roles, top_role: (role, count) of the column role in the order of ROLES, and the most frequent (of equals the first of them)."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0)), F.lit(100))
    counted = rows.groupBy(*keys, "role").agg(F.count("*").alias("n")).withColumn("rank", rank)
    return counted.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", (-F.col("n")).alias("less"), "role"))), lambda x: F.struct(x["role"].alias("role"), (-x["less"]).alias("n"))).alias("roles"),
        F.min_by("role", F.struct(-F.col("n"), "rank", "role")).alias("top_role"),
    )


def counter_summary(rows: DataFrame, keys: list[str], label: str, order: str, top: int) -> DataFrame:
    """keys, summary: the top most frequent labels as ``label xN``, of equals the one first in order; NO_COUNT without a label."""
    counted = rows.groupBy(*keys, label).agg(F.count(label).alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first", label))
    kept = counted.withColumn("place", place).where(F.col("place") <= top + 1)
    shown = F.when(F.col(label).isNotNull(), F.struct("place", F.concat(F.col(label), F.lit(" x"), F.col("n").cast("string")).alias("s")))
    joined = F.concat_ws(" ", F.transform(F.slice(F.array_sort(F.collect_list(shown)), 1, top), lambda x: x["s"]))
    return kept.groupBy(*keys).agg(joined.alias("summary")).withColumn("summary", F.when(F.col("summary") == "", NO_COUNT).otherwise(F.col("summary")))


def convergences(flow: DataFrame, keys: list[str], order: str, most: int = 4) -> DataFrame:
    """keys, place, item: where two neighbours end alike and share their tone or emotion, each item once, in order, most of each key.

    flow: keys, order, ending, tone, emotion.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    same = lambda c: F.col(c) == F.lead(c).over(w)
    pairs = flow.select(*keys, F.col(order).alias("at"), "ending", "tone", "emotion", same("ending").alias("e"), same("tone").alias("t"), same("emotion").alias("m")).where("e")
    item = lambda kind, c: F.concat("ending", F.lit(f"+{kind}:"), c, F.lit(" x2"))
    both = F.array(F.when(F.col("t") & (F.col("tone") != WEAK_TONE), item("tone", "tone")), F.when(F.col("m") & (F.col("emotion") != WEAK_EMOTION), item("emotion", "emotion")))
    items = pairs.select(*keys, "at", F.posexplode(both).alias("i", "item")).where("item is not null").groupBy(*keys, "item").agg(F.min(F.struct("at", "i")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    return items.select(*keys, place.alias("place"), "item").where(F.col("place") <= most)


def bucket_rank(bucket: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, BUCKETS)), bucket)
    return F.when(at > 0, at - 1).otherwise(UNKNOWN_BUCKET)


def best_candidates(rows: DataFrame, keys: list[str], order: str, first: int | None = 20, most: int | None = 12) -> DataFrame:
    """keys, place, name, bucket, n: of each name among the first rows the entry of the best bucket, by rank and then by first appearance.

    rows: keys, order, name, bucket.  first and most limit the rows read and the
    names returned for each key; None reads or returns all.
    """
    if first is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__n") <= first)
    ranked = rows.withColumn("__r", bucket_rank(F.col("bucket")))
    chosen = ranked.groupBy(*keys, "name").agg(F.min_by("bucket", F.struct("__r", "bucket", order)).alias("bucket"), F.min("__r").alias("__r"), F.min(order).alias("__first"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__r", "__first", "name"))
    out = chosen.select(*keys, place.alias("place"), "name", "bucket", "n")
    return out if most is None else out.where(F.col("place") <= most)


def deposition_target(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair]), kind), F.lit(TEMPLATE_TARGET))


def inferred_candidate(key: Column, term: bool = False) -> Column:
    """(bucket, name, suggested_target) of ``bucket::name``: without a mark all is bucket; a term's bucket is learned_filter."""
    at = F.instr(key, "::")
    name = F.when(at > 0, F.substr(key, at + 2)).otherwise(F.lit(""))
    bucket = F.lit("learned_filter") if term else F.when(at > 0, F.substr(key, F.lit(1), at - 1)).otherwise(key)
    return F.struct(bucket.alias("bucket"), name.alias("name"), F.lit(TERM_TARGET if term else TEMPLATE_TARGET).alias("suggested_target"))


def consistency_bonus(counts: DataFrame) -> DataFrame:
    """counts (designed_keep, false_positive, pending, more columns) with bonus: names of what a story's feedback earns, at most two."""
    kept = F.when(F.col("designed_keep") >= 1, F.lit(KEPT_BONUS))
    done = F.when((F.col("false_positive") >= 1) & (F.col("pending") == 0), F.lit(DONE_BONUS))
    return counts.withColumn("bonus", F.array_compact(F.array(kept, done)))


def repeated_ids(profiles: DataFrame, column: str = "id") -> DataFrame:
    """column, n: ids that a set of profiles holds more than once, null and empty ones among them."""
    return profiles.groupBy(F.coalesce(F.col(column), F.lit("")).alias(column)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col(column) == ""))
