"""Quality rules by distribution divergence, in DataFrame functions only.

The character-class histogram and the common-word histogram of a document are
compared with those of each language reference by the Jensen-Shannon distance
(base 2, so between 0 and 1); a document passes if one reference is near in
both.  Too short documents fail before that.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"
#: Classes of the character histogram: lower case, upper case, other letters, digits, plain punctuation, all else; white space counts in none.
CLASSES = ("lower", "upper", "letter", "digit", "mark", "other")
_MARKS = ".,;:!?'\"()-"


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes, and of common words among all words, of one language."""

    name: str
    classes: tuple[float, ...]
    words: dict[str, float] = field(hash=False)

    @property
    def farthest(self) -> float:
        """Word distance of a text without a common word."""
        seen = sum(self.words.values())
        return math.sqrt(0.5 * seen + 0.5 * math.log2(2 / (2 - seen)) + 0.5 * (1 - seen) * math.log2(2 * (1 - seen) / (2 - seen)))


def _words(text: str) -> dict[str, float]:
    pairs = [x.split(":") for x in text.split()]
    return {w: float(p) / 1000 for w, p in pairs}


#: Rounded frequencies per thousand words of running text.
REFERENCES = (
    Reference("en", (0.925, 0.035, 0.001, 0.003, 0.034, 0.002), _words("the:60 of:30 and:28 to:26 a:22 in:20 is:12 that:11 for:10 it:10 was:9 with:8 as:8 on:8 be:7 by:6 at:5 from:5 are:5 this:5 not:5 or:4 an:4 have:4 which:3")),
    Reference("fr", (0.885, 0.035, 0.043, 0.003, 0.032, 0.002), _words("de:50 la:30 le:25 et:24 les:22 des:20 en:15 un:14 du:13 une:12 que:11 est:10 pour:9 qui:9 dans:9 par:8 au:7 sur:7 plus:5 elle:4 ou:4 pas:4 se:4 il:6 ce:4")),
    Reference("de", (0.875, 0.060, 0.022, 0.003, 0.038, 0.002), _words("der:35 die:33 und:30 in:20 den:14 von:13 zu:12 das:12 mit:11 sich:9 des:9 auf:9 ist:9 im:9 dem:9 nicht:8 ein:8 eine:7 als:7 auch:5 es:6 an:6 er:5 so:3 dass:4")),
    Reference("es", (0.900, 0.035, 0.025, 0.003, 0.035, 0.002), _words("de:60 la:38 que:30 el:28 en:26 y:26 a:20 los:17 se:12 del:12 las:11 un:10 por:9 con:9 no:8 una:8 para:7 su:7 al:6 es:6 lo:6 como:5 más:4 o:4 sus:3")),
)
#: Largest class distance of a document that passes, its largest word distance as a share of the reference's farthest, and the words under which a document fails or its words aren't compared.
MAX_CLASS, MAX_WORDS, MIN_WORDS, MIN_COMPARED = 0.33, 0.8, 50, 100


def _terms(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence."""
    half = lambda x: F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def features(docs: DataFrame) -> DataFrame:
    """docs with a struct of the counts that the rules use in the column __f; text is read whole."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.withColumn("__t", text)
    base = base.withColumn("__w", F.regexp_extract_all("__t", F.lit(_WORD), F.lit(0)))
    base = base.withColumn("__s1", F.translate("__t", _LOWER, "")).withColumn("__s2", F.translate("__s1", _SPACES, ""))
    base = base.withColumn("__s3", F.translate("__s2", _LOWER.upper(), "")).withColumn("__s4", F.translate("__s3", _MARKS, "")).withColumn("__s5", F.translate("__s4", "0123456789", ""))
    length = F.char_length
    letters = length("__s5") - length(F.regexp_replace("__s5", r"\p{L}+", ""))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    n = F.size("__w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("__w", i), F.element_at("__w", i + 1), F.element_at("__w", i + 2)))).otherwise(F.array().cast("array<long>"))
    base = base.withColumn("__lines", lines).withColumn("__win", windows)
    base = base.withColumn("__sorted", F.when(F.size(F.array_distinct("__win")) < F.size("__win"), F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    near = lambda k: F.get("__sorted", k)["h"]
    again = F.transform("__sorted", lambda x, k: F.when((x["h"] == F.coalesce(near(k - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(near(k + 1), F.bitwise_not(x["h"]))), x["i"]))
    base = base.withColumn("__at", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    common = sorted({w for r in REFERENCES for w in r.words})
    base = base.withColumn("__c", F.filter(F.transform("__w", lambda w: F.lower(w)), lambda w: w.isin(common)))
    counted = F.transform(F.array_distinct("__c"), lambda w: F.struct(w.alias("w"), F.size(F.filter("__c", lambda x: x == w)).alias("n")))
    found = F.struct(
        n.cast("long").alias("n_words"), length(F.translate("__t", _SPACES, "")).cast("long").alias("word_chars"), (length("__t") - length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.array(length("__t") - length("__s1"), length("__s2") - length("__s3"), letters, length("__s4") - length("__s5"), length("__s3") - length("__s4"), length("__s5") - letters).alias("classes"), counted.alias("common"),
    )
    return base.select(*docs.columns, F.explode(F.array(found)).alias("__f"))  # a Generate, past which no filter on the results copies these expressions


def divergences(classes: Column, common: Column, n_words: Column, reference: Reference) -> tuple[Column, Column]:
    """Jensen-Shannon distances of the class and common-word histograms from the reference's."""
    total = F.aggregate(classes, F.lit(0), lambda a, x: a + x)
    of_classes = sum((_terms(classes[i] / F.greatest(total, F.lit(1)), F.lit(q)) for i, q in enumerate(reference.classes)), F.lit(0.0))
    shares = F.create_map(*[F.lit(x) for pair in reference.words.items() for x in pair])
    rest = 1 - sum(reference.words.values())
    own = F.filter(common, lambda s: s["w"].isin(list(reference.words)))
    words = F.greatest(n_words, F.lit(1)).cast("double")
    inside = F.aggregate(own, F.lit(0.0), lambda a, s: a + _terms(s["n"] / words, F.element_at(shares, s["w"])))
    seen = F.aggregate(own, F.lit(0.0), lambda a, s: a + F.element_at(shares, s["w"]))
    others = _terms(1 - F.aggregate(own, F.lit(0), lambda a, s: a + s["n"]) / words, F.lit(rest))
    return F.sqrt(F.greatest(of_classes, F.lit(0.0))), F.sqrt(F.greatest(inside + others + 0.5 * (1 - rest - seen), F.lit(0.0)))


def judge(docs: DataFrame, references: tuple[Reference, ...] = REFERENCES, max_class: float = MAX_CLASS, max_words: float = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, language, class_distance, word_distance.

    docs: doc_id, text, more columns, which are ignored, whatever their
    names.  base_failed: under MIN_WORDS words, or over half of the words in
    repeated 3-word windows.  kept: not base_failed, and one reference is
    within max_class and, where the text has MIN_COMPARED words, within
    max_words of its farthest, the distance of a text without a common word.  language is the nearest reference (of those equal to nine digits the first by name).  A
    null text counts as empty and fails; repeated rows get equal results; an
    empty table gives none.
    """
    rated = features(docs.select("doc_id", "text")).select("doc_id", "__f")
    f = F.col("__f")
    distances = []
    for r in references:
        of_classes, of_words = divergences(f["classes"], f["common"], f["n_words"], r)
        distances.append(F.struct(F.round(of_classes / max_class + of_words / (max_words * r.farthest), 9).alias("sum"), F.lit(r.name).alias("name"), of_classes.alias("classes"), of_words.alias("words"), F.lit(max_words * r.farthest).alias("limit")))
    rated = rated.withColumn("__all", F.array(*distances)).withColumn("__d", F.array_min("__all"))
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    d = F.col("__d")
    near = F.exists("__all", lambda x: (x["classes"] <= max_class) & ((f["n_words"] < MIN_COMPARED) | (x["words"] <= x["limit"])))
    return rated.select(
        "doc_id", *[f[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & near).alias("kept"),
        d["name"].alias("language"), d["classes"].alias("class_distance"), d["words"].alias("word_distance"),
    )


def _sql() -> str:
    """The query op7 in DuckDB's SQL, with REFERENCES as values."""
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN 0.5 * {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    classes = ", ".join(f"('{r.name}', {k}, {q!r}::DOUBLE)" for r in REFERENCES for k, q in enumerate(r.classes))
    words = ", ".join(f"('{r.name}', '{w}', {q!r}::DOUBLE)" for r in REFERENCES for w, q in r.words.items())
    names = ", ".join(f"('{r.name}', {1 - sum(r.words.values())!r}::DOUBLE, {MAX_WORDS * r.farthest!r}::DOUBLE)" for r in REFERENCES)
    only = lambda c: f"length(regexp_replace(t, '[^{c}]', '', 'g'))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
tok AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
tri AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) v(j) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, r, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {only("#*$%&|<>")} AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  {only("a-z")} AS c0, {only("A-Z")} AS c1, {only(chr(92) + "p{L}")} - c0 - c1 AS c2, {only("0-9")} AS c3, {only(".,;:!?'()" + chr(34) + chr(92) + "-").replace("'()", "''()")} AS c4, word_chars - c0 - c1 - c2 - c3 - c4 AS c5
  FROM t JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN again USING (r)),
share AS (SELECT r, unnest([c0, c1, c2, c3, c4, c5]) / greatest(word_chars, 1)::DOUBLE AS p, unnest(range(6)) AS k FROM f),
dc AS (SELECT r, name, sqrt(greatest(sum({half("p", "q")} + {half("q", "p")}), 0)) AS classes FROM share JOIN (VALUES {classes}) c(name, k, q) USING (k) GROUP BY r, name),
common AS (SELECT r, lower(w) AS w, count(*) AS n FROM tok GROUP BY ALL),
n AS (VALUES {names}),
ref AS (SELECT * FROM n AS x(name, rest, far)),
own AS (SELECT r, name, sum(n) AS n, sum({half("p", "q")} + {half("q", "p")}) AS s, sum(q) AS seen
  FROM (SELECT f.r, v.name, v.q, common.n, common.n / greatest(f.n_words, 1)::DOUBLE AS p FROM common JOIN f USING (r) JOIN (VALUES {words}) v(name, w, q) USING (w)) GROUP BY r, name),
left_over AS (SELECT f.r, name, far, rest, coalesce(s, 0) AS s, 1 - coalesce(own.n, 0) / greatest(n_words, 1)::DOUBLE AS p, coalesce(seen, 0) AS seen FROM f CROSS JOIN ref LEFT JOIN own USING (r, name)),
dw AS (SELECT r, name, far, sqrt(greatest(s + {half("p", "rest")} + {half("rest", "p")} + 0.5 * (1 - rest - seen), 0)) AS words FROM left_over),
d AS (SELECT r, name, far, classes, words, round(classes / {MAX_CLASS} + words / far, 9) AS together FROM dc JOIN dw USING (r, name)),
best AS (SELECT r, arg_min(name, (together, name)) AS language FROM d GROUP BY r),
near AS (SELECT r, bool_or(classes <= {MAX_CLASS} AND (n_words < {MIN_COMPARED} OR words <= far)) AS near FROM d JOIN f USING (r) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND near AS kept, language
FROM f JOIN best USING (r) JOIN near USING (r)
"""


SQL = _sql()
