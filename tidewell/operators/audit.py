"""Audits of drafts: sentences and paragraphs with their lines, densities of rules and terms, runs, windows, profiles and scores.

docs are (doc_id, text).  Word lists come from a lexicon or rules table, which
is small by nature; sentences and paragraphs are spread over the tasks, and
what reads a document in order works on one document at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What ends a sentence, and what counts as a character of prose; fixed values.
SENTENCE = r"[^。！？!?]+(?:[。！？!?]+|$)|[。！？!?]+"
PROSE = r"[A-Za-z0-9一-鿿]"
QUOTES, LEADING = "“「\"", " \t　“”「」\"'—…-"


@dataclass(frozen=True)
class Lexicon:
    """Word lists and thresholds of an audit."""

    judgement: tuple[str, ...] = ("显然", "其实", "obviously", "clearly")
    sticky: tuple[str, ...] = ("然后", "于是", "then")
    subjects: tuple[str, ...] = ("他", "她", "He ", "She ", "The ")
    connectives: tuple[str, ...] = ("但是", "所以", "But ", "So ")
    operation: str = r"把[^，。]{1,8}"
    short: int = 12
    very_short: int = 6
    run: int = 3
    window: int = 5
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, line_no, text, chars) of all sentences, in order; chars counts prose characters."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    parts = lines.select("doc_id", "line", F.posexplode(F.filter(F.transform(F.regexp_extract_all("l", F.lit(SENTENCE), 0), T.trimmed), lambda s: s != "")).alias("i", "text"))
    w = Window.partitionBy("doc_id").orderBy("line", "i")
    return parts.select("doc_id", F.row_number().over(w).alias("idx"), (F.col("line") + 1).alias("line_no"), "text", prose_chars(F.col("text")).alias("chars"))


def prose_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PROSE))


def is_dialogue(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"^\s*[{QUOTES}]")) | F.rlike(text, F.lit("：[“「]|:\\s*\""))


def quote_ratio(text: Column) -> Column:
    """Share of the characters between quotes."""
    quoted = F.aggregate(F.regexp_extract_all(text, F.lit(r"[“「][^”」]*[”」]|\"[^\"]*\""), 0), F.lit(0), lambda a, q: a + F.char_length(q))
    return F.when(F.char_length(text) > 0, quoted / F.char_length(text)).otherwise(0.0)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, line_start, line_end, text, chars, dialogue) of the stretches between blank lines."""
    from ..sources.files import passages

    rows = docs.select("doc_id", F.posexplode(passages(F.col("text"))).alias("i", "p"))
    return rows.select("doc_id", (F.col("i") + 1).alias("idx"), "p.line_start", "p.line_end", "p.text", prose_chars(F.col("p.text")).alias("chars"), is_dialogue(F.col("p.text")).alias("dialogue"))


def length_profile(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Of each document's sentences: number, shortest, longest, mean, shares of short and very short ones, and of dialogue."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.min("chars").alias("shortest"), F.max("chars").alias("longest"), F.round(F.avg("chars"), 2).alias("mean"), share(F.col("chars") <= lexicon.short).alias("short"), share(F.col("chars") <= lexicon.very_short).alias("very_short"), share(is_dialogue(F.col("text"))).alias("dialogue"))


def islands(rows: DataFrame, flag: Column, least: int, keys: tuple[str, ...] = ("doc_id",), order: str = "idx") -> DataFrame:
    """(keys, first, last, length) of the runs of rows that bear the flag, of a least length."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = rows.withColumn("__r", F.row_number().over(w)).where(flag)
    on = on.withColumn("__g", F.col("__r") - F.row_number().over(w))
    return on.groupBy(*keys, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__g")


def short_runs(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    return islands(rows, F.col("chars") <= lexicon.short, lexicon.run)


def dialogue_runs(rows: DataFrame, least: int = 4, most_chars: int | None = None, pattern: str | None = None) -> DataFrame:
    """Runs of dialogue paragraphs, only short ones or those with a pattern (questions, say) if asked for."""
    flag = is_dialogue(F.col("text"))
    if most_chars is not None:
        flag = flag & (F.col("chars") <= most_chars)
    if pattern is not None:
        flag = flag & F.rlike("text", F.lit(pattern))
    return islands(rows, flag, least)


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)) if terms else F.lit(False)


def hits(text: Column, term: Column) -> Column:
    """Occurrences of a text in another without overlap; none of the empty one."""
    n = F.char_length(term)
    return F.when(n > 0, (F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / n).otherwise(0).cast("long")


def rule_density(docs: DataFrame, rules: list[tuple[str, str, float]], samples: int = 3) -> DataFrame:
    """For each document and rule (name, pattern, most for 10,000 characters): matches, density, whether it warns, and the first lines that match."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"), F.lit(float(m)).alias("most")) for n, p, m in rules])
    rows = docs.select("doc_id", prose_chars(F.col("text")).alias("chars"), F.split("text", "\n").alias("lines"), F.explode(table).alias("r"))
    own = F.filter("lines", lambda l: F.rlike(l, F.col("r.pattern")))
    n = F.aggregate(F.transform(own, lambda l: F.regexp_count(l, F.col("r.pattern"))), F.lit(0), lambda a, b: a + b)
    raw = F.when(F.col("chars") > 0, n * 10000.0 / F.col("chars")).otherwise(0.0)
    return rows.select("doc_id", "r.name", n.cast("long").alias("count"), F.round(raw, 2).alias("per_10k"), (raw > F.col("r.most")).alias("warn"), F.transform(F.slice(own, 1, samples), T.trimmed).alias("samples"))


def term_metrics(docs: DataFrame, terms: list[tuple[str, str, float]]) -> DataFrame:
    """Terms (category, term, most for 10,000 characters) that a document has: count, density and whether it warns."""
    table = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.lit(float(m)).alias("most")) for c, t, m in terms])
    rows = docs.select("doc_id", "text", prose_chars(F.col("text")).alias("chars"), F.explode(F.filter(table, lambda t: F.contains(F.col("text"), t["term"]))).alias("t"))
    n = hits(F.col("text"), F.col("t.term"))
    raw = F.when(F.col("chars") > 0, n * 10000.0 / F.col("chars")).otherwise(0.0)
    return rows.select("doc_id", "t.category", "t.term", n.alias("count"), F.round(raw, 2).alias("per_10k"), (raw > F.col("t.most")).alias("warn"))


def by_category(metrics: DataFrame, top: int = 8) -> DataFrame:
    """Counts of each category with its most frequent terms, ties by term."""
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "term"))), 1, top), lambda x: x["term"])
    return metrics.groupBy("doc_id", "category").agg(F.sum("count").alias("count"), F.max("warn").alias("warn"), ranked.alias("top"))


def named_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.where(F.col("name").isin(names) & (F.col("count") > 0))


def templates(bank: DataFrame, built_in: DataFrame) -> DataFrame:
    """Templates (name, pattern, enabled) that count: with a pattern, enabled, and not shadowed by a built-in of the same name."""
    return bank.where((F.trim("pattern") != "") & F.col("enabled")).join(built_in.select("name"), "name", "left_anti")


def learned_metrics(docs: DataFrame, learned: list[tuple[str, float]]) -> DataFrame:
    """Learned phrases (phrase, most) that a document has twice or more, those that warn first."""
    out = term_metrics(docs, [("learned", p, m) for p, m in learned]).where("count >= 2").drop("category")
    return out.orderBy("doc_id", F.desc("warn"), F.desc("count"), "term")


def ngrams(docs: DataFrame, least: dict[int, int], stop: tuple[str, ...] = ()) -> DataFrame:
    """(gram, n, count) of Han character grams over all documents with their least counts; grams with a stop character go, and so does a gram that a longer one covers with at least as many."""
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[一-鿿]+"), 0)).alias("run"))
    sized = runs.select("run", F.explode(F.array(*[F.lit(n) for n in least])).alias("n")).where(F.char_length("run") >= F.col("n"))
    grams = sized.select("n", F.explode(F.expr("transform(sequence(1, char_length(run) - n + 1), i -> substring(run, i, n))")).alias("gram"))
    counted = grams.groupBy("gram", "n").agg(F.count("*").alias("count"))
    need = F.create_map(*[x for n, c in least.items() for x in (F.lit(n), F.lit(c))])
    kept = counted.where(F.col("count") >= F.element_at(need, F.col("n")))
    if stop:
        kept = kept.where(~F.rlike("gram", F.lit("[" + "".join(stop) + "]")))
    longer = kept.select(F.explode(F.expr("array_distinct(flatten(transform(sequence(1, n - 1), k -> transform(sequence(1, n - k + 1), i -> substring(gram, i, k)))))")).alias("gram"), F.col("count").alias("c")).groupBy("gram").agg(F.max("c").alias("c"))
    return kept.join(longer, "gram", "left").where(F.col("c").isNull() | (F.col("c") < F.col("count"))).drop("c")


def first_of(text: Column, leads: tuple[str, ...]) -> Column:
    """The first of the leads, in order, that the text starts with after quotes and blanks; null if none."""
    stripped = F.regexp_replace(text, f"^[{LEADING.replace('-', '')}-]+", "")
    return F.get(F.filter(F.array(*[F.lit(x) for x in leads]), lambda x: stripped.startswith(x)), F.lit(0))


def leads(rows: DataFrame, words: tuple[str, ...], least: int = 2) -> DataFrame:
    """(doc_id, lead, n) of sentences or paragraphs by what they start with."""
    return rows.select("doc_id", first_of(F.col("text"), words).alias("lead")).where("lead IS NOT NULL").groupBy("doc_id", "lead").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def starts(rows: DataFrame, chars: int = 2, least: int = 2) -> DataFrame:
    return rows.select("doc_id", F.substring("text", 1, chars).alias("start")).groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clauses(rows: DataFrame) -> DataFrame:
    """(doc_id, idx, place, clause) of what stands between commas."""
    return rows.select("doc_id", "idx", F.posexplode(F.filter(F.transform(F.split("text", "[，,、；;]"), T.trimmed), lambda c: c != "")).alias("place", "clause"))


def clause_prefixes(rows: DataFrame, chars: int = 4, least: int = 4) -> DataFrame:
    return clauses(rows).where(F.char_length("clause") >= chars).groupBy("doc_id", F.substring("clause", 1, chars).alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clause_pairs(rows: DataFrame, chars: int = 2, least: int = 2) -> DataFrame:
    """Beginnings of neighbouring clauses that recur."""
    c = clauses(rows).select("doc_id", "idx", "place", F.substring("clause", 1, chars).alias("a"))
    w = Window.partitionBy("doc_id", "idx").orderBy("place")
    return c.withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL").groupBy("doc_id", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def balanced(rows: DataFrame, spread: int = 2) -> DataFrame:
    """Sentences with 3 to 5 clauses in a row whose lengths differ by spread at most, and the words doubled as AABB or AA in them."""
    c = clauses(rows).groupBy("doc_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "clause"))), lambda x: x["clause"]).alias("c"))
    sizes = F.transform("c", lambda x: F.char_length(x))
    even = (F.size("c") >= 3) & (F.size("c") <= 5) & (F.array_max(sizes) - F.array_min(sizes) <= spread)
    doubled = F.regexp_extract_all(F.array_join("c", ""), F.lit(r"([一-鿿])\1([一-鿿])\2|([一-鿿])\3"), 0)
    return c.select("doc_id", "idx", F.size("c").alias("clauses"), even.alias("even"), doubled.alias("doubled")).where("even OR size(doubled) > 0")


def label_hits(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """(label, hits) of each label's terms in a text."""
    return F.array(*[F.struct(F.lit(k).alias("label"), sum((hits(text, F.lit(t)) for t in terms), F.lit(0).cast("long")).alias("hits")) for k, terms in rules.items()])


def best_label(text: Column, rules: dict[str, tuple[str, ...]], unclear: str = "unclear") -> Column:
    """The label with most hits, ties by label; unclear if none has any."""
    top = F.element_at(F.array_sort(F.transform(label_hits(text, rules), lambda x: F.struct((-x["hits"]).alias("n"), x["label"].alias("label")))), 1)
    return F.when(top["n"] < 0, top["label"]).otherwise(unclear)


def first_label(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that fits."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(F.rlike(text, F.lit(pattern)), label).otherwise(out)
    return out


def flow(rows: DataFrame, label: Column, weight: Column | None = None) -> DataFrame:
    """(doc_id, counts, switches, longest): labels of rows in order, weighted, and how often the label changes."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    told = rows.withColumn("label", label).withColumn("w", weight if weight is not None else F.lit(1))
    told = told.withColumn("new", F.coalesce(F.col("label") != F.lag("label").over(w), F.lit(False)).cast("int")).withColumn("run", F.sum("new").over(w))
    sums = told.groupBy("doc_id", "label").agg(F.sum("w").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    runs = told.groupBy("doc_id", "run").agg(F.count("*").alias("c"), F.max("new").alias("s")).groupBy("doc_id").agg((F.count("*") - 1).alias("switches"), F.max("c").alias("longest"))
    return sums.join(runs, "doc_id")


def voices(rows: DataFrame, speaker: str = r"^\s*([^：:“\"\s]{1,12})[：:]") -> DataFrame:
    """(doc_id, speaker, lines, mean_chars, questions) of lines that name their speaker."""
    named = rows.withColumn("speaker", F.regexp_extract("text", speaker, 1)).where("speaker <> ''")
    return named.groupBy("doc_id", "speaker").agg(F.count("*").alias("lines"), F.round(F.avg("chars"), 2).alias("mean_chars"), F.round(F.avg(F.rlike("text", F.lit("[？?]")).cast("int")), 4).alias("questions"))


def alike(profiles: DataFrame, chars: float = 2.0, questions: float = 0.1, least: int = 3) -> DataFrame:
    """Pairs of speakers of a document whose profiles hardly differ; a document has few speakers."""
    a = profiles.where(F.col("lines") >= least)
    b = a.select("doc_id", F.col("speaker").alias("other"), F.col("mean_chars").alias("c2"), F.col("questions").alias("q2"))
    return a.join(b, "doc_id").where((F.col("speaker") < F.col("other")) & (F.abs(F.col("mean_chars") - F.col("c2")) <= chars) & (F.abs(F.col("questions") - F.col("q2")) <= questions)).select("doc_id", "speaker", "other")


def viewpoints(rows: DataFrame, anchors: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, switches, overlaps): changes of the one viewpoint that paragraphs anchor, and paragraphs with several."""
    found = F.array(*[F.when(has_any(F.col("text"), terms), F.lit(k)) for k, terms in anchors.items()])
    told = rows.withColumn("who", F.array_compact(found))
    w = Window.partitionBy("doc_id").orderBy("idx")
    one = told.where(F.size("who") == 1).withColumn("who", F.get("who", F.lit(0))).withColumn("s", F.coalesce(F.col("who") != F.lag("who").over(w), F.lit(False)).cast("int"))
    overlaps = told.groupBy("doc_id").agg(F.sum((F.size("who") > 1).cast("int")).alias("overlaps"))
    return overlaps.join(one.groupBy("doc_id").agg(F.sum("s").alias("switches")), "doc_id", "left").select("doc_id", F.coalesce("switches", F.lit(0)).alias("switches"), "overlaps")


#: Thresholds of a window's indicators and their weights in its score; fixed values.
INDICATORS = {"short": (3, 2), "very_short": (2, 1), "judgement": (2, 2), "operation": (2, 2), "sticky": (2, 1), "role": (3, 1), "dialogue": (4, 1), "list": (2, 1)}


def fatigue_windows(rows: DataFrame, lexicon: Lexicon, most: int | None = None) -> DataFrame:
    """Windows of five sentences that tire: counts of eight indicators, their score, chosen by falling score and place without overlap.

    Documents of four sentences are one window; the choice reads one
    document's candidates in order.
    """
    t = F.regexp_replace("text", f"^[{LEADING.replace('-', '')}-]+", "")
    flags = {
        "short": F.col("chars") <= lexicon.short, "very_short": F.col("chars") <= lexicon.very_short, "judgement": has_any(t, lexicon.judgement), "operation": F.rlike(t, F.lit(lexicon.operation)), "sticky": has_any(t, lexicon.sticky),
        "role": first_of(F.col("text"), lexicon.subjects).isNotNull(), "dialogue": is_dialogue(F.col("text")), "list": F.regexp_count(t, F.lit("[，、]")) >= 3,
    }
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(0, lexicon.window - 1)
    every = Window.partitionBy("doc_id")
    counted = rows.select("doc_id", "idx", F.count("*").over(w).alias("n"), F.count("*").over(every).alias("all"), *[F.sum(f.cast("int")).over(w).alias(k) for k, f in flags.items()])
    full = (F.col("n") == lexicon.window) | ((F.col("all") == lexicon.window - 1) & (F.col("idx") == 1))
    tired = F.array_compact(F.array(*[F.when(F.col(k) >= least, F.lit(k)) for k, (least, _) in INDICATORS.items()]))
    score = sum((F.col(k) * weight for k, (_, weight) in INDICATORS.items()), F.lit(0))
    found = counted.where(full).select("doc_id", F.col("idx").alias("first"), (F.col("idx") + F.col("n") - 1).alias("last"), score.cast("long").alias("score"), tired.alias("reasons")).where(F.size("reasons") > 0)
    return chosen(found, "first long, last long, score long, reasons array<string>", most)


def chosen(found: DataFrame, schema: str, most: int | None) -> DataFrame:
    """Of each document's windows (first, last, score, ...) the best by falling score and place that don't overlap, at most so many."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        keep = []
        for i, r in rows.sort_values(["score", "first"], ascending=[False, True]).iterrows():
            span = set(range(int(r["first"]), int(r["last"]) + 1))
            if not span & taken:
                taken |= span
                keep.append(i)
                if most is not None and len(keep) >= most:
                    break
        return rows.loc[keep, ["doc_id", *columns]]

    return found.groupBy("doc_id").applyInPandas(pick, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {schema}")


def term_windows(rows: DataFrame, terms: list[tuple[str, str]], size: int, least: int = 3, most: int | None = None) -> DataFrame:
    """Windows of sentences crowded with tracked terms (category, term): 3 * its top term's sentences + all + its top category's, at least so many sentences with a term."""
    table = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("term")) for c, t in terms])
    own = rows.select("doc_id", "idx", F.filter(table, lambda x: F.contains(F.col("text"), x["term"])).alias("t"))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(0, size - 1)
    win = own.select("doc_id", F.col("idx").alias("first"), F.max("idx").over(w).alias("last"), F.flatten(F.collect_list("t").over(w)).alias("t")).where((F.col("last") - F.col("first") == size - 1) & (F.size("t") >= least))
    top = lambda f: F.array_max(F.transform(F.array_distinct(F.transform("t", lambda x: x[f])), lambda v: F.size(F.filter("t", lambda x: x[f] == v))))
    scored = win.select("doc_id", F.col("first").cast("long"), F.col("last").cast("long"), (3 * top("term") + F.size("t") + top("category")).cast("long").alias("score"))
    return chosen(scored, "first long, last long, score long", most)


def axis_gaps(rows: DataFrame, axis: tuple[str, ...], size: int = 4) -> DataFrame:
    """(doc_id, first) of windows of nothing but dialogue without a term of any axis."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(0, size - 1)
    counted = rows.select("doc_id", F.col("idx").alias("first"), F.sum((is_dialogue(F.col("text")) & ~has_any(F.col("text"), axis)).cast("int")).over(w).alias("n"))
    return counted.where(F.col("n") == size).drop("n")


def battles(rows: DataFrame, terms: tuple[str, ...], least: int = 2) -> DataFrame:
    """Runs of sentences with a term of battle, with all their occurrences."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    n = sum((hits(F.col("text"), F.lit(t)) for t in terms), F.lit(0).cast("long"))
    on = rows.withColumn("n", n).where("n > 0").withColumn("g", F.col("idx") - F.row_number().over(w))
    return on.groupBy("doc_id", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("length"), F.sum("n").alias("hits")).where(F.col("length") >= least).drop("g")


def scenes(rows: DataFrame, role: Column, longest: int = 6) -> DataFrame:
    """(doc_id, scene, role, first, last): paragraphs of one role in a row, with a forced break where a block grows too long.

    Breaks depend on the block so far, so one document is read in turn.
    """

    def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for idx, r in part.sort_values("idx")[["idx", "role"]].itertuples(index=False):
            if out and out[-1][2] == r and out[-1][5] < longest:
                out[-1][4], out[-1][5] = idx, out[-1][5] + 1
            else:
                out.append([key[0], len(out) + 1, r, idx, idx, 1])
        return pd.DataFrame([o[:5] for o in out], columns=["doc_id", "scene", "role", "first", "last"])

    named = rows.select("doc_id", "idx", role.alias("role"))
    return named.groupBy("doc_id").applyInPandas(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, scene long, role string, first long, last long")


def axis_score(base: float, penalties: list[Column], bonuses: list[Column], low: float = 1.0, high: float = 5.0) -> Column:
    """A score from its base, less penalties, plus bonuses, within its bounds."""
    total = F.lit(base) - sum(penalties, F.lit(0.0)) + sum(bonuses, F.lit(0.0))
    return F.least(F.greatest(total, F.lit(low)), F.lit(high))


def gate(first_priority: Column, warned: Column, mean_axis: Column, hard: Column) -> Column:
    """FAIL, WATCH or PASS from the first-priority findings, sections that warn, mean score and hard findings; fixed limits."""
    fail = (first_priority >= 4) | (warned >= 16) | (mean_axis < 2.4) | (hard >= 22)
    watch = (first_priority >= 2) | (warned >= 10) | (mean_axis < 3.4) | (hard >= 12)
    return F.when(fail, "FAIL").when(watch, "WATCH").otherwise("PASS")


def missing_headings(sections: DataFrame, required: list[tuple[str, ...]]) -> DataFrame:
    """(path, heading) of required headings, each any of a group, that a plan lacks."""
    groups = F.array(*[F.array(*[F.lit(h) for h in g]) for g in required])
    own = sections.groupBy("path").agg(F.collect_set("section").alias("s"))
    return own.select("path", F.explode(F.filter(groups, lambda g: ~F.arrays_overlap(g, F.col("s")))).alias("g")).select("path", F.get("g", F.lit(0)).alias("heading"))


def monotony(values: DataFrame, key: str, term: str) -> DataFrame:
    """Generic terms that all but one or more of a plan's events share: count at least the larger of 2 and n - 1."""
    n = values.groupBy(key).agg(F.count("*").alias("n"))
    top = values.where(F.col(term).isNotNull()).groupBy(key, term).agg(F.count("*").alias("c"))
    return top.join(n, key).where(F.col("c") >= F.greatest(F.lit(2), F.col("n") - 1)).select(key, term, "c", "n")


EMPTY = ("", "-", "待补充", "TBD")


def card_warnings(cards: DataFrame, kinds: dict[str, tuple[str, tuple[str, ...]]], category_field: str = "category", id_field: str = "id") -> DataFrame:
    """(path, warning, field) of concept cards (path, category, fields): unknown category, missing and empty fields, another category within, ids without their prefix.

    kinds: id prefix and needed fields of each category.
    """
    table = F.create_map(*[x for k, (p, f) in kinds.items() for x in (F.lit(k), F.struct(F.lit(p).alias("prefix"), F.array(*[F.lit(n) for n in f]).alias("need")))])
    rows = cards.withColumn("k", F.element_at(table, F.col("category")))
    value = lambda n: F.element_at("fields", n)
    warn = lambda c, w, n: F.when(c, F.struct(F.lit(w).alias("warning"), n.alias("field")))
    need = F.coalesce("k.need", F.array().cast("array<string>"))
    empty = lambda v: v.isin(*EMPTY) | F.contains(v, F.lit("已确认 / 待确认"))
    found = F.concat(
        F.array(warn(F.col("k").isNull(), "unknown_category", F.col("category"))),
        F.transform(F.filter(need, lambda n: value(n).isNull()), lambda n: F.struct(F.lit("missing_field").alias("warning"), n.alias("field"))),
        F.transform(F.filter(need, lambda n: value(n).isNotNull() & empty(value(n))), lambda n: F.struct(F.lit("empty_field").alias("warning"), n.alias("field"))),
        F.array(warn(value(F.lit(category_field)) != F.col("category"), "category_mismatch", F.lit(category_field)), warn(~value(F.lit(id_field)).startswith(F.col("k.prefix")), "bad_id_prefix", F.lit(id_field))),
    )
    return rows.select("path", F.explode(F.array_compact(found)).alias("w")).select("path", "w.warning", "w.field")


def rewritten(docs: DataFrame, rewrites: DataFrame) -> DataFrame:
    """docs with each sentence of rewrites (doc_id, sentence, rewrite) replaced, longer ones first."""
    own = rewrites.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.char_length("sentence")).alias("n"), "sentence", "rewrite"))).alias("r"))
    joined = docs.join(own, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("r").isNotNull(), F.aggregate("r", F.col("text"), lambda t, x: F.replace(t, x["sentence"], x["rewrite"]))).otherwise(F.col("text"))).drop("r")
