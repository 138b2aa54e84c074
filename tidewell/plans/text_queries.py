"""Queries of the text functions, chunking, windows and counts over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.similarity import following
from .base import TOKENS, TURNS, query, read, turns

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, 'doc-' || md5({_TRIM.format('text')}) AS content_id FROM documents")
def fn_content_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.content_id("doc-", F.col("text")).alias("content_id"))


_ENT = r"'(?i)&(?:amp|lt|gt|quot|apos|nbsp|#x\+?[0-9a-f]+|#\+?[0-9]+);'"
_RESOLVED = "CASE lower({0}) WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN chr(39) WHEN '&nbsp;' THEN chr(160) ELSE CASE WHEN lower({0}) LIKE '&#x%' THEN chr(('0x' || regexp_extract({0}, '(?i)x\\+?([0-9a-f]+)', 1))::INT) ELSE chr(regexp_extract({0}, '[0-9]+')::INT) END END"


def _unescaped(text: str) -> str:
    """SQL of html_unescape: the pieces between entities, each followed by what its entity stands for."""
    cut, found = f"regexp_split_to_array({text}, {_ENT})", f"regexp_extract_all({text}, {_ENT})"
    return f"array_to_string(list_transform(range(1, len({cut}) + 1), lambda i: {cut}[i] || coalesce(CASE WHEN i <= len({found}) THEN {_RESOLVED.format(f'{found}[i]')} END, '')), '')"


@query(f"SELECT page_id, md5(u) AS unescaped, length(u) AS n_chars FROM (SELECT page_id, {_unescaped('html')} AS u FROM pages)")
def fn_html_unescape(spark: SparkSession, d: str) -> DataFrame:
    u = T.html_unescape(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.md5(u).alias("unescaped"), F.char_length(u).cast("long").alias("n_chars"))


@query(rf"WITH t AS (SELECT page_id, {_TRIM.format('html')} AS html FROM pages) SELECT page_id, md5(regexp_replace({_unescaped('html')}, '[\x00-\x1f\x7f-\x{{9f}}]', '', 'g')) AS cleaned FROM t")
def fn_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(T.clean(F.col("html"))).alias("cleaned"))


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def fn_token_set(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(rf"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\||!!|###'), lambda s: {_TRIM.format('s')}), lambda s: s <> '')[1] AS first_piece, len(list_filter(list_transform(regexp_split_to_array(text, '\||!!|###'), lambda s: {_TRIM.format('s')}), lambda s: s <> '')) AS n_pieces FROM documents")
def fn_split_markers(spark: SparkSession, d: str) -> DataFrame:
    p = T.split_markers(F.col("text"), ("|", "!!", "###"))
    return read(spark, d, "documents").select("doc_id", F.get(p, F.lit(0)).alias("first_piece"), F.size(p).cast("long").alias("n_pieces"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS folded, substr(text, 1, 200) AS summary FROM documents")
def fn_whitespace_summary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.folded_space(F.col("text"))).alias("folded"), T.summary(F.col("text")).alias("summary"))


@query("SELECT doc_id, " + ", ".join("regexp_matches(text, '{}') AS {}".format(p.replace("'", "''"), n) for n, p in T.CREDENTIALS) + " FROM documents")
def fn_credential_screen(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", *[F.rlike("text", F.lit(p)).alias(n) for n, p in T.CREDENTIALS])


@query(rf"SELECT doc_id, len(s) AS n_sentences, coalesce(list_min(list_transform(s, lambda x: length(x))), 0) AS shortest, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest, len(list_filter(s, lambda x: length(x) < 20)) AS n_short FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def agg_sentence_profile(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select("doc_id", F.transform(T.sentences(F.col("text")), F.char_length).alias("n"))
    big = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return s.select("doc_id", F.size("n").cast("long").alias("n_sentences"), big(F.array_min("n")).alias("shortest"), big(F.array_max("n")).alias("longest"), F.size(F.filter("n", lambda x: x < 20)).cast("long").alias("n_short"))


@query(rf"""WITH s AS (SELECT doc_id, list_sort(list_transform({_SENT}, lambda x: length(x))) AS n FROM documents)
SELECT doc_id, n[round_even((len(n) - 1) * 0.10, 0)::INT + 1] AS p10, n[round_even((len(n) - 1) * 0.25, 0)::INT + 1] AS p25, n[round_even((len(n) - 1) * 0.5, 0)::INT + 1] AS median FROM s WHERE len(n) > 0""")
def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Order statistics at half-even rounded positions."""
    s = read(spark, d, "documents").select("doc_id", F.array_sort(F.transform(T.sentences(F.col("text")), F.char_length)).alias("n")).where(F.size("n") > 0)
    at = lambda q: F.get("n", F.bround((F.size("n") - 1) * F.lit(q)).cast("int")).cast("long")
    return s.select("doc_id", at(0.10).alias("p10"), at(0.25).alias("p25"), at(0.5).alias("median"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 100)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, start // 100 AS seq, len(w[start + 1:start + 120]) AS n_tokens, md5(array_to_string(w[start + 1:start + 120], ' ')) AS chunk_key FROM s""")
def win_chunking(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 120 words that overlap by 20, a last one of nothing but overlap included."""
    w = read(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("w"))
    c = w.select("doc_id", F.explode(T.token_windows(F.col("w"), 120, 20)).alias("c"))
    return c.select("doc_id", F.floor(F.col("c.start") / 100).cast("long").alias("seq"), F.size("c.tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("c.tokens", " ")).alias("chunk_key"))


@query(f"""WITH {TURNS}, b AS (SELECT conv_id, turn, len(regexp_split_to_array(content, '\\s+')) + 1 AS cost FROM turns), c AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM b), f AS (SELECT *, sum(CASE WHEN used > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS over FROM c)
SELECT conv_id, turn, used::BIGINT AS used FROM f WHERE over = 0""")
def win_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Turns from the first on while their tokens, and one more each, fit 150; all after the first overflow go."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    b = turns(spark, d).select("conv_id", "turn", (F.size(F.split("content", r"\s+")) + 1).alias("cost"))
    return b.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= 150).select("conv_id", "turn", "used")


@query(f"WITH {TURNS} SELECT conv_id, max(turn) AS last_turn, arg_max(role, timestamp) AS last_role, max(timestamp) AS mark FROM turns GROUP BY conv_id")
def win_latest_turn(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "timestamp").alias("last_role"), F.max("timestamp").alias("mark"))


@query(f"""WITH {TURNS}, l AS (SELECT conv_id, turn, role, lag(role, 1) OVER w AS r1, lag(role, 2) OVER w AS r2, lag(role, 3) OVER w AS r3 FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM l WHERE role = r2 AND r1 = r3 AND role <> r1""")
def win_alternation(spark: SparkSession, d: str) -> DataFrame:
    """Ends of A-B-A-B runs of roles."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    l = turns(spark, d).select("conv_id", "turn", "role", *[F.lag("role", i).over(w).alias(f"r{i}") for i in (1, 2, 3)])
    return l.where((F.col("role") == F.col("r2")) & (F.col("r1") == F.col("r3")) & (F.col("role") != F.col("r1"))).select("conv_id", "turn")


@query(rf"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM documents), m AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s WHERE length(s) < 25)
SELECT doc_id, min(i) AS first_sentence, count(*) AS run_length FROM m GROUP BY doc_id, g HAVING count(*) >= 3""")
def win_short_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three or more short sentences, by gaps and islands."""
    s = read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s")).where(F.char_length("s") < 25)
    g = s.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i")))
    return g.groupBy("doc_id", "g").agg((F.min("i") + 1).cast("long").alias("first_sentence"), F.count("*").alias("run_length")).where("run_length >= 3").drop("g")


@query(rf"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM documents), w AS (SELECT doc_id, i, sum(length(s)) OVER x AS chars, sum(CASE WHEN length(s) < 25 THEN 1 ELSE 0 END) OVER x AS short, count(*) OVER x AS n FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT doc_id, i AS first_sentence, chars::BIGINT AS chars, short::BIGINT AS short FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY short DESC, chars, i) AS r FROM w WHERE n = 5) WHERE r = 1""")
def win_sliding_five(spark: SparkSession, d: str) -> DataFrame:
    """The window of five sentences with most short ones in each document."""
    s = read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    x = Window.partitionBy("doc_id").orderBy("i").rowsBetween(0, 4)
    w = s.select("doc_id", "i", F.sum(F.char_length("s")).over(x).alias("chars"), F.sum((F.char_length("s") < 25).cast("int")).over(x).alias("short"), F.count("*").over(x).alias("n")).where("n = 5")
    r = w.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("short"), "chars", "i"))).where("r = 1")
    return r.select("doc_id", (F.col("i") + 1).cast("long").alias("first_sentence"), "chars", "short")


_TERMS = ("the", "que", "der", "la")


@query("SELECT lang, term, sum(n)::BIGINT AS matches, sum(chars)::BIGINT AS chars, round(sum(n) * 10000.0 / sum(chars), 4) AS per_10k, sum(n) * 10000.0 / sum(chars) > 50 AS warn FROM (" + " UNION ALL ".join(f"SELECT lang, '{t}' AS term, len(list_filter({TOKENS}, lambda w: w = '{t}')) AS n, length(text) AS chars FROM documents" for t in _TERMS) + ") GROUP BY lang, term")
def agg_rule_density(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each term for 10,000 characters of each language."""
    docs = read(spark, d, "documents").select("lang", "text", T.tokens(F.col("text")).alias("w"))
    rows = docs.select("lang", F.char_length("text").alias("chars"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter("w", (lambda t: lambda w: w == t)(t))).alias("n")) for t in _TERMS])).alias("x"))
    density = F.sum("x.n") * 10000.0 / F.sum("chars")
    return rows.groupBy("lang", F.col("x.term").alias("term")).agg(F.sum("x.n").alias("matches"), F.sum("chars").alias("chars"), F.round(density, 4).alias("per_10k"), (density > 50).alias("warn"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS word, generate_subscripts({TOKENS}, 1) AS pos FROM documents), c AS (SELECT word, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM t GROUP BY word) SELECT word, n FROM c ORDER BY n DESC, first LIMIT 50")
def agg_most_common(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent words, of equals the one seen first."""
    t = read(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    c = t.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return c.orderBy(F.desc("n"), "first").limit(50).select("word", "n")


@query(f"WITH w AS (SELECT unnest({TOKENS}) AS w FROM documents), c AS (SELECT w, count(*) AS c FROM w GROUP BY w), g AS (SELECT w, c, unnest([2, 3, 4]) AS n FROM c), x AS (SELECT n, substr(w, i::INT, n) AS gram, c FROM (SELECT w, c, n, unnest(range(1, length(w) - n + 2)) AS i FROM g WHERE length(w) >= n)) SELECT gram, n, total FROM (SELECT gram, n, sum(c)::BIGINT AS total, row_number() OVER (PARTITION BY n ORDER BY sum(c) DESC, gram) AS r FROM x GROUP BY gram, n) WHERE r <= 20")
def agg_char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent 2-, 3- and 4-character grams of words; words are counted first."""
    c = read(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    g = c.select("w", "c", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("n")).where(F.char_length("w") >= F.col("n"))
    x = g.select("n", "c", F.explode(F.expr("transform(sequence(1, char_length(w) - n + 1), i -> substring(w, i, n))")).alias("gram"))
    t = x.groupBy("gram", "n").agg(F.sum("c").alias("total"))
    best = [t.where(F.col("n") == k).orderBy(F.desc("total"), "gram").limit(20) for k in (2, 3, 4)]
    return best[0].union(best[1]).union(best[2]).select("gram", "n", "total")


@query(rf"""WITH s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE len(w) >= 5)
SELECT a.doc_id, round(len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def set_shingle_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the 5-word shingles of neighbouring documents."""
    found = following(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


@query(rf"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), b AS (SELECT doc_id, ('0x' || substr(md5(w), 15, 2))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""")
def fn_hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Sparse rows of the hashed bag of words, of length 1."""
    t = read(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w"))
    b = t.groupBy("doc_id", T.md5_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))
    return b.select("doc_id", "bucket", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id"))), 6).alias("weight"))


@query(r"SELECT doc_id, i AS line_start, md5(l) AS passage FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS l, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS i FROM documents) WHERE regexp_matches(l, '\S')")
def fn_passages(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines with their numbers."""
    p = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).where(F.rlike("l", F.lit(r"\S")))
    return p.select("doc_id", (F.col("i") + 1).cast("long").alias("line_start"), F.md5("l").alias("passage"))


@query(f"WITH t AS (SELECT conv_id, turn, unnest({TOKENS}) AS w, generate_subscripts({TOKENS}, 1) AS p FROM conversations), f AS (SELECT conv_id, w, min({{'t': turn, 'p': p}}) AS first FROM t GROUP BY conv_id, w) SELECT conv_id, md5(string_agg(w, ' ' ORDER BY first)) AS seen, count(*) AS n FROM f GROUP BY conv_id")
def win_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each conversation in the order in which they come first."""
    t = turns(spark, d).select("conv_id", "turn", F.posexplode(T.tokens(F.col("content"))).alias("p", "w"))
    f = t.groupBy("conv_id", "w").agg(F.min(F.struct("turn", "p")).alias("first"))
    g = f.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "w"))).alias("x"))
    return g.select("conv_id", F.md5(F.array_join(F.col("x.w"), " ")).alias("seen"), F.size("x").cast("long").alias("n"))


@query("WITH j AS (SELECT d.doc_id, abs(n_chars % 100) / 100.0 AS confidence, quality = 1 AS correct FROM documents d JOIN labels USING (doc_id)), b AS (SELECT least(14, greatest(0, ceil(confidence * 15)::INT - 1)) AS bin, * FROM j) SELECT bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy, round(abs(avg(confidence) - avg(correct::INT)) * count(*) / (SELECT count(*) FROM j), 6) AS share FROM b GROUP BY bin")
def agg_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Bins of the expected calibration error: 15 of equal width, the first closed; the error is the sum of share."""
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select((F.abs(F.col("n_chars") % 100) / 100.0).alias("confidence"), (F.col("quality") == 1).cast("int").alias("correct"))
    b = j.withColumn("bin", F.least(F.lit(14), F.greatest(F.lit(0), F.ceil(F.col("confidence") * 15).cast("int") - 1)))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("correct").alias("a"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select("bin", "n", F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")) * F.col("n") / total, 6).alias("share"))


@query("SELECT lang, toxic, count(*) AS n, count(DISTINCT source) AS sources, round(avg(quality), 6) AS quality, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT AS long_docs FROM documents JOIN labels USING (doc_id) GROUP BY lang, toxic")
def agg_label_quality(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return j.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(F.avg("quality"), 6).alias("quality"), F.sum((F.col("n_chars") > 2000).cast("long")).alias("long_docs"))
