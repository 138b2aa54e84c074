"""URL verdicts from rules and from an empirical-Bayes reputation of hosts, in DataFrame functions only.

Each host has a beta-binomial posterior of its rate of bad pages.  Its prior
is centred on the posterior mean of its registered domain, whose prior is
centred on that of its suffix, whose prior is centred on the overall rate.
The weight of the prior at each level is estimated from the spread of the
level's rates by moments.  A host is blocked where even the lower bound of its
posterior is above the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host and path) in the order of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of two labels under which domains are registered.
SECOND_LEVEL = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
#: Standard deviations below the posterior mean, and the rate above which that bound blocks.
DEVIATIONS, THRESHOLD = 1.0, 0.5
LEAST_WEIGHT, MOST_WEIGHT, NO_SPREAD = 1.0, 1000.0, 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    deep = two.isin(list(SECOND_LEVEL))
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(two), F.when(deep, two).otherwise(F.substring_index(host, ".", -1))


def _weight(level: DataFrame, rate: float) -> float:
    """The prior's weight in pages, from the spread of the rates k / n around the overall rate."""
    q, many, free = level.where("n > 0").agg(F.sum(F.col("n") * (F.col("k") / F.col("n") - rate) * (F.col("k") / F.col("n") - rate)), F.count("*"), F.sum(F.col("n") - 1)).first()
    if not many or not free or not 0 < rate < 1:
        return NO_SPREAD
    share = (q / (rate * (1 - rate)) - many) / free
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / share - 1)) if share > 0 else MOST_WEIGHT


def reputation(hosts: DataFrame) -> DataFrame:
    """host, n, k, alpha, beta, bound of the (host, n, k) of hosts: labelled pages, bad ones, posterior, lower bound."""
    domain, suffix = _levels(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    rate = ((k or 0) + 1) / ((n or 0) + 2)
    weights = [_weight(x, rate) for x in (hosts, domains, suffixes)]
    suffixes = suffixes.select("suffix", ((F.col("k") + weights[2] * rate) / (F.col("n") + weights[2])).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + weights[1] * F.col("of_suffix")) / (F.col("n") + weights[1])).alias("of_domain"))
    a, b = F.col("k") + weights[0] * F.col("of_domain"), F.col("n") - F.col("k") + weights[0] * (1 - F.col("of_domain"))
    rated = hosts.join(domains, "domain").select("host", "n", "k", a.alias("alpha"), b.alias("beta"))
    total = F.col("alpha") + F.col("beta")
    return rated.withColumn("bound", F.col("alpha") / total - DEVIATIONS * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1))))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.

    pages: page_id, url, more columns, which are ignored, whatever their
    names.  outcomes: page_id, bad (boolean; null rows and null outcomes don't
    count; a page with several outcomes counts as bad if one is).  A fitting
    rule decides, the longest if several fit; else the reputation of the host,
    ``block`` if its bound is above the threshold.  A null url, or one without
    ``://``, has an empty host and path and the verdict of the empty host, which
    shares all such pages.  Repeated rows get equal verdicts; an empty table
    gives none; without outcomes every host has the overall prior.
    """
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    bounds = reputation(materialize(hosts, "hosts")).select("host", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(bounds, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"))


#: The query op9 in DuckDB's SQL, with outcomes from the table labels.
SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
known AS (SELECT doc_id AS page_id, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k, string_split(host, '.') AS l FROM p LEFT JOIN known USING (page_id) GROUP BY host),
h1 AS (SELECT *, array_to_string(l[-2:], '.') AS two FROM h0),
h AS (SELECT host, n, k, CASE WHEN two IN ('ac.uk','co.in','co.jp','co.nz','co.uk','com.au','com.br','org.uk') THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
  CASE WHEN two IN ('ac.uk','co.in','co.jp','co.nz','co.uk','com.au','com.br','org.uk') THEN two ELSE l[-1] END AS suffix FROM h1),
d AS (SELECT domain, first(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
g AS (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS rate FROM s),
spread AS (
  SELECT 'h' AS lv, sum(n * (k::DOUBLE / n - rate) * (k::DOUBLE / n - rate)) AS q, count(*) AS m, sum(n - 1) AS f, any_value(rate) AS rate FROM h, g WHERE n > 0
  UNION ALL SELECT 'd', sum(n * (k::DOUBLE / n - rate) * (k::DOUBLE / n - rate)), count(*), sum(n - 1), any_value(rate) FROM d, g WHERE n > 0
  UNION ALL SELECT 's', sum(n * (k::DOUBLE / n - rate) * (k::DOUBLE / n - rate)), count(*), sum(n - 1), any_value(rate) FROM s, g WHERE n > 0),
share AS (SELECT lv, m, f, rate, CASE WHEN f > 0 THEN (q / (rate * (1 - rate)) - m) / f END AS x FROM spread),
w AS (SELECT lv, CASE WHEN m = 0 OR f = 0 OR f IS NULL THEN 10.0 WHEN x > 0 THEN least(1000.0, greatest(1.0, 1 / x - 1)) ELSE 1000.0 END AS v FROM share),
s2 AS (SELECT suffix, (k + (SELECT v FROM w WHERE lv = 's') * rate) / (n + (SELECT v FROM w WHERE lv = 's')) AS ms FROM s, g),
d2 AS (SELECT domain, (k + (SELECT v FROM w WHERE lv = 'd') * ms) / (n + (SELECT v FROM w WHERE lv = 'd')) AS md FROM d JOIN s2 USING (suffix)),
h2 AS (SELECT host, k + (SELECT v FROM w WHERE lv = 'h') * md AS a, n - k + (SELECT v FROM w WHERE lv = 'h') * (1 - md) AS b FROM h JOIN d2 USING (domain)),
r AS (SELECT host, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h2),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN r USING (host)
"""
