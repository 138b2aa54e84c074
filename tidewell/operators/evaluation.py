"""Evaluation of recall: cases, quality and latency, calibration of judges, why a marker was missed, and the search for better knobs.

Cases are (case_id, set, query_id, expected array, forbidden array, top_k);
hits are (case_id, query_id, rank, summary).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as X

BINS = 15
#: Why a marker didn't come back, in the order in which the reasons are tried; fixed values.
STAGES = ("NotCaptured", "Delivered", "NotCurrent", "InvisibleToScope", "StaleFiltered", "AllArmsMissed", "JudgeCleared", "RankedOut", "DemotedByJudge", "Indeterminate")


def quality(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """For each query: recall of its expected markers in the summaries of its top hits, whether one is missed, whether a forbidden one came, and whether the first hit is right."""
    own = hits.join(cases.select("case_id", "query_id", "top_k"), ["case_id", "query_id"]).where(F.col("rank") <= F.col("top_k"))
    texts = own.groupBy("case_id", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "summary"))), lambda x: x["summary"]).alias("texts"))
    j = cases.join(texts, ["case_id", "query_id"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    has = lambda m: F.exists("texts", lambda t: F.contains(t, m))
    found = F.size(F.filter("expected", has))
    recall = F.when(F.size("expected") > 0, found / F.size("expected")).otherwise(1.0)
    first = F.when(F.size("texts") > 0, F.exists("expected", lambda m: F.contains(F.get("texts", F.lit(0)), m))).otherwise(False)
    return j.select("case_id", "set", "query_id", recall.alias("recall"), (found < F.size("expected")).alias("missed"), F.exists("forbidden", has).alias("wrong"), first.alias("top_hit"))


def case_results(queries: DataFrame) -> DataFrame:
    return queries.groupBy("case_id", "set").agg(F.avg("recall").alias("recall_at_k"), F.avg(F.col("missed").cast("int")).alias("miss_rate"), F.avg(F.col("wrong").cast("int")).alias("wrong_evidence_rate"), F.min(F.col("top_hit").cast("int")).alias("top_hits"))


def passed(results: DataFrame, conditions: DataFrame) -> DataFrame:
    """results with passed: conditions (case_id, min_recall, forbid_wrong_evidence, expect_top_hit)."""
    ok = (F.col("recall_at_k") >= F.col("min_recall")) & (~F.col("forbid_wrong_evidence") | (F.col("wrong_evidence_rate") == 0)) & (~F.col("expect_top_hit") | (F.col("top_hits") == 1))
    return results.join(conditions, "case_id").select(*results.columns, ok.alias("passed"))


def pooled_recall(queries: DataFrame) -> DataFrame:
    return queries.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def latency(samples: DataFrame, by: list[str], micros: str = "micros") -> DataFrame:
    """P50 and P95 of each group, as the samples at n / 2 and n * 95 / 100."""
    s = samples.groupBy(*by).agg(F.array_sort(F.collect_list(micros)).alias("s"))
    at = lambda n, d: F.get("s", F.least(F.floor(F.size("s") * n / d).cast("int"), F.size("s") - 1))
    return s.select(*by, at(1, 2).alias("p50"), at(95, 100).alias("p95"), F.size("s").alias("samples"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = BINS) -> DataFrame:
    """One row, ece: the mean gap between confidence and accuracy over bins of equal width, the first one closed."""
    edge = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins)))
    b = rows.groupBy(edge.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("int")).alias("a"))
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def selected(probabilities: Column) -> Column:
    """The option of the highest probability, ties to the first by name."""
    entries = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.get(entries, F.lit(0))["k"]


def margin(probabilities: Column) -> Column:
    """How far the best option is ahead of the second."""
    p = F.sort_array(F.map_values(probabilities), asc=False)
    return F.when(F.size(p) > 1, F.get(p, F.lit(0)) - F.get(p, F.lit(1))).when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(0.0)


#: When a judge's choice is taken, when something counts as found or absent, and how far probabilities may miss one; fixed values.
ACCEPT, AHEAD, FOUND, ABSENT, TOLERANCE = 0.85, 0.5, 0.7, 0.35, 0.01


def valid_choice(probabilities: Column, options: list[str]) -> Column:
    """Whether an answer gives each option once, none else, each a probability, and one in all."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return F.coalesce((F.array_sort(F.map_keys(probabilities)) == F.array(*[F.lit(o) for o in sorted(options)])) & F.forall(values, lambda v: (v >= 0) & (v <= 1)) & (F.abs(total - 1) <= TOLERANCE), F.lit(False))


def decision(probabilities: Column) -> Column:
    """The choice if it is sure enough and far enough ahead; else null, an abstention."""
    return F.when((F.array_max(F.map_values(probabilities)) >= ACCEPT) & (margin(probabilities) >= AHEAD), selected(probabilities))


def presence(p: Column) -> Column:
    return F.when(p >= FOUND, "found").when(p < ABSENT, "absent").otherwise("unsure")


def tier_metrics(answers: DataFrame) -> DataFrame:
    """For each tier: accuracy of the answers given, shares of abstentions and of answers that flip between repeats of a question, and the calibration error.

    answers: (tier, op, question_id, repeat, choice, gold, confidence); a null choice abstains.
    """
    given = F.col("choice").isNotNull()
    right = (F.col("choice") == F.col("gold")).cast("int")
    base = answers.groupBy("tier").agg(F.avg(F.when(given, right)).alias("accuracy"), F.avg((~given).cast("int")).alias("abstain_rate"), F.count("*").alias("decisions"))
    flips = answers.groupBy("tier", "question_id").agg((F.count_distinct(F.coalesce("choice", F.lit("\u0000"))) > 1).cast("int").alias("f")).groupBy("tier").agg(F.avg("f").alias("flip_rate"))
    edge = F.least(F.lit(BINS), F.greatest(F.lit(1), F.ceil(F.col("confidence") * BINS)))
    bins = answers.where(given).groupBy("tier", edge.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(right).alias("a"))
    ece = bins.groupBy("tier").agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))
    return base.join(flips, "tier").join(ece, "tier", "left")


def by_operation(answers: DataFrame) -> DataFrame:
    return answers.where("choice IS NOT NULL").groupBy("tier", "op").agg(F.avg((F.col("choice") == F.col("gold")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def curve(tiers: DataFrame) -> DataFrame:
    """Tiers (tier, place, accuracy, footprint, components) with the gain over the one before and the components that came and went."""
    w = Window.orderBy("place")
    before = F.lag("components").over(w)
    none = F.array().cast("array<string>")
    return tiers.select("*", (F.col("accuracy") - F.lag("accuracy").over(w)).alias("gain"), (F.col("footprint") - F.lag("footprint").over(w)).alias("cost"), F.array_except("components", F.coalesce(before, none)).alias("added"), F.array_except(F.coalesce(before, none), "components").alias("removed"))


def draw(label: str) -> float:
    """A number in [0, 1] that the label alone decides: the first 16 hex digits of its md5."""
    return int(hashlib.md5(label.encode()).hexdigest()[:16], 16) / (2**64 - 1)


def draw_column(label: Column) -> Column:
    digits = F.md5(label)
    part = lambda a: F.conv(F.substring(digits, a, 8), 16, 10).cast("double")
    return (part(1) * float(2**32) + part(9)) / float(2**64 - 1)


def mock_answers(questions: DataFrame, skill: float) -> DataFrame:
    """Answers of a judge that is right with a chance of skill, drawn by label: questions (question_id, gold, wrong)."""
    u = draw_column(F.concat("question_id", F.lit(":"), F.lit(str(skill))))
    return questions.select("question_id", "gold", F.when(u < skill, F.col("gold")).otherwise(F.col("wrong")).alias("choice"), (0.5 + u / 2).alias("confidence"))


def attribution(markers: DataFrame) -> DataFrame:
    """markers with stage, the first reason that holds.

    (captured, delivered, current, visible, stale, position, judged, exists,
    candidates, top_k): position is the marker's place in the fused list
    without a judge, null if no arm had it.
    """
    hidden = F.col("stale") & F.col("position").isNotNull()
    stage = (
        F.when(~F.col("captured"), "NotCaptured").when(F.col("delivered"), "Delivered").when(~F.col("current"), "NotCurrent").when(~F.col("visible"), "InvisibleToScope").when(hidden, "StaleFiltered")
        .when(F.col("position").isNull(), "AllArmsMissed").when(F.col("judged") & ~F.col("exists") & (F.col("candidates") == 0), "JudgeCleared").when(F.col("position") >= F.col("top_k"), "RankedOut").when(F.col("judged"), "DemotedByJudge").otherwise("Indeterminate")
    )
    return markers.withColumn("stage", stage)


@dataclass(frozen=True)
class Knob:
    """A number that recall reads, its bounds, and the stage whose misses it can mend."""

    id: str
    value: float
    step: float
    low: float | None = None
    high: float | None = None
    stage: str = ""

    def admits(self, value: float) -> bool:
        return (self.low is None or value >= self.low) and (self.high is None or value <= self.high)


#: Knobs of recall in the order in which they are tried; defaults and bounds are fixed values.
KNOBS = (Knob("recall.graph_hops", 2, 1, 1, None, "AllArmsMissed"), Knob("recall.candidate_cap", 250, 50, 1, None, "RankedOut"), Knob("recall.rel_correction", 1.5, 0.1, 0, None, "RankedOut"), Knob("recall.rel_support", 1.2, 0.1, 0, None, "RankedOut"), Knob("recall.near_zero", 0.05, 0.05, 0, 1, "JudgeCleared"))


def knobs_for(stage: str) -> list[str]:
    return [k.id for k in KNOBS if k.stage == stage]


@dataclass
class Search:
    """Coordinate descent over knobs: one step from the present value at a time, kept only if it passes all rules.

    measure(knobs, set) gives {case_id: (recall, wrong_rate, passed)} of the
    tuning or the holdout set.  A step must stay in bounds, regress no case of
    either set, bring no wrong evidence, not lower the holdout's recall, and
    gain more than the noise floor.
    """

    measure: Callable[[dict[str, float], str], dict[str, tuple[float, float, bool]]]
    floor: float
    knobs: dict[str, Knob] = field(default_factory=lambda: {k.id: k for k in KNOBS})
    refuted: set[tuple[str, float]] = field(default_factory=set)
    tried: set[tuple[str, float]] = field(default_factory=set)
    accepted: list[tuple[str, float]] = field(default_factory=list)

    def propose(self) -> tuple[str, float] | None:
        for k in self.knobs.values():
            for value in (round(k.value + k.step, 9), round(k.value - k.step, 9)):
                if (k.id, value) not in self.refuted | self.tried and k.admits(value):
                    return k.id, value
        return None

    def evaluate(self, step: tuple[str, float]) -> tuple[str, float]:
        """(verdict, gain): accept, out_of_bounds, regression or noise_floor."""
        name, value = step
        if not self.knobs[name].admits(value):
            self.refuted.add(step)
            return "out_of_bounds", 0.0
        self.tried.add(step)
        now = {k.id: k.value for k in self.knobs.values()}
        before = {s: self.measure(now, s) for s in ("tuning", "holdout")}
        after = {s: self.measure(now | {name: value}, s) for s in ("tuning", "holdout")}
        if not before["tuning"] or not before["holdout"]:
            return "regression", 0.0
        mean = lambda r: sum(x[0] for x in r.values()) / len(r)
        for s in ("tuning", "holdout"):
            for case, (recall, wrong, ok) in after[s].items():
                was = before[s][case]
                if recall < was[0] or wrong > 0 or was[2] and not ok or wrong > was[1]:
                    self.refuted.add(step)
                    return "regression", 0.0
        if mean(after["holdout"]) < mean(before["holdout"]):
            self.refuted.add(step)
            return "regression", 0.0
        gain = mean(after["tuning"]) - mean(before["tuning"])
        return ("accept", gain) if gain > self.floor else ("noise_floor", gain)

    def commit(self, step: tuple[str, float], verdict: str) -> None:
        """Keep an accepted step; every direction that wasn't refuted is open again."""
        if verdict != "accept":
            raise ValueError("only an accepted step is kept")
        self.knobs[step[0]] = replace(self.knobs[step[0]], value=step[1])
        self.accepted.append(step)
        self.tried.clear()

    def run(self, most: int = 100) -> list[tuple[str, float]]:
        for _ in range(most):
            step = self.propose()
            if step is None:
                break
            verdict, _ = self.evaluate(step)
            if verdict == "accept":
                self.commit(step, verdict)
        return self.accepted

    def scoreboard(self) -> str:
        return X.canonical_json({"knobs": {k.id: k.value for k in self.knobs.values()}, "accepted": self.accepted, "refuted": sorted(self.refuted)})


#: Words of which distractors are made; fixed values.
VOCABULARY = ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel")


def distractors(spark: SparkSession, scale: int, turns: int = 4) -> DataFrame:
    """(conversation_id, turn_id, role, content, timestamp) of so many sessions of filler turns, the same every time."""
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    i = F.col("id")
    text = F.concat_ws(" ", *[F.element_at(words, (F.pmod(i * (k + 3) + k, F.lit(len(VOCABULARY))) + 1).cast("int")) for k in range(6)])
    return spark.range(scale * turns).select(F.concat(F.lit("distractor-"), F.floor(i / turns).cast("string")).alias("conversation_id"), F.concat(F.lit("d"), (i % turns).cast("string")).alias("turn_id"), F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("content"), (i * 1000).alias("timestamp"))


def chain(spark: SparkSession, length: int) -> tuple[DataFrame, DataFrame]:
    """Facts in a row, each joined to the next, of which only the first has the words of the query: the case for a walk of many hops."""
    nodes = spark.range(length).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") == 0, "start of the trail").otherwise(F.concat(F.lit("marker "), F.col("id").cast("string"))).alias("text"))
    edges = spark.range(length - 1).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("dst"), F.lit("Related").alias("rel"), F.lit(1.0).alias("weight"))
    return nodes, edges


STOP = ("the", "and", "for", "that", "with", "what", "when", "where", "which", "who", "how", "did", "does", "was", "were", "are", "you", "have", "has")


def probe_terms(question: Column, evidence: Column) -> Column:
    """Words of the question that the evidence has too: three ASCII letters or more, no stop words, each once, in order."""
    words = lambda t: F.split(F.lower(t), "[^A-Za-z0-9]+")
    fit = F.filter(words(question), lambda w: (F.char_length(w) >= 3) & F.rlike(w, F.lit("^[a-z]+$")) & ~w.isin(*STOP))
    return F.array_intersect(fit, words(evidence))


def frozen(rows: list[dict]) -> tuple[str, list[dict]]:
    """The criteria and the hash that stands for them; each row has an id of its own, questions with ids of their own, and probabilities that add up."""
    if len({r["row_id"] for r in rows}) != len(rows):
        raise ValueError("two rows have one id")
    for r in rows:
        ids = [q["question_id"] for q in r["questions"]]
        if len(set(ids)) != len(ids):
            raise ValueError(f"{r['row_id']}: two questions have one id")
        for q in r["questions"]:
            p = q.get("gold", {}).get("probabilities")
            if p and abs(sum(p.values()) - 1) > TOLERANCE:
                raise ValueError(f"{q['question_id']}: the probabilities don't add up to one")
    return X.snapshot_hash(rows), rows
