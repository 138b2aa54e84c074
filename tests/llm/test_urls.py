from __future__ import annotations

import random
import re

import duckdb

from tidewell.llm import urls


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(r), r, v) for v, r in urls.RULES for own, tail in [r.split("/", 1)] if (host == own or host.endswith("." + own)) and path.startswith("/" + tail)]
    return max(fits)[1:] if fits else (None, None)


def posterior_bounds(pages, bad, weights, rate):
    hosts = {}
    for p, url in pages:
        n, k = hosts.get(parts(url)[0], (0, 0))
        hosts[parts(url)[0]] = (n + (p in bad), k + bad.get(p, 0))
    domain = lambda h: ".".join(h.split(".")[-(3 if ".".join(h.split(".")[-2:]) in urls.SECOND_LEVEL else 2) :])
    suffix = lambda h: ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in urls.SECOND_LEVEL else h.split(".")[-1]
    out = {}
    for h, (n, k) in hosts.items():
        s = [v for x, v in hosts.items() if suffix(x) == suffix(h)]
        d = [v for x, v in hosts.items() if domain(x) == domain(h)]
        of_s = (sum(x[1] for x in s) + weights[2] * rate) / (sum(x[0] for x in s) + weights[2])
        of_d = (sum(x[1] for x in d) + weights[1] * of_s) / (sum(x[0] for x in d) + weights[1])
        a, b = k + weights[0] * of_d, n - k + weights[0] * (1 - of_d)
        out[h] = a / (a + b) - (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    return out


def planted():
    rng = random.Random(3)
    hosts = ["a.co.uk", "b.a.co.uk", "good.org", "www.good.org", "bad.net", "x.bad.net", "www.example.com", "deep.www.example.com", "example.com", "net", "one.fr", "h"]
    pages = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts).upper() if i % 3 == 0 else rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/x', '/fr/?q', '/en', '?a://b', '#/es/'])}") for i in range(300)]
    pages += [(300, None), (301, "no scheme"), (302, "://"), (303, "a://b://c/d"), (303, "a://b://c/d")]
    bad = {i: int(("bad" in (u or "").lower()) != (rng.random() < 0.1)) for i, u in pages if rng.random() < 0.6}
    return pages, bad


def test_against_brute_force_and_sql(spark, monkeypatch):
    pages, bad = planted()
    p = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, rule string")
    o = spark.createDataFrame([*[(i, b == 1) for i, b in bad.items()], (None, True), (1, None)], "page_id long, bad boolean")
    seen = []
    weight = urls._weight
    monkeypatch.setattr(urls, "_weight", lambda level, rate: seen.append((weight(level, rate), rate)) or seen[-1][0])
    got = sorted(tuple(r) for r in urls.judge(p, o).collect())
    bounds = posterior_bounds(pages, bad, [w for w, _ in seen], seen[0][1])
    want = []
    for i, u in pages:
        host, path = parts(u)
        r, v = rule(host, path)
        want.append((i, host, path, r, v or ("block" if bounds[host] > urls.THRESHOLD else "allow")))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, toxic INT)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    con.executemany("INSERT INTO labels VALUES (?, ?)", list(bad.items()))
    assert sorted(con.execute(urls.SQL).fetchall(), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    p = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    o = spark.createDataFrame([], "page_id long, bad boolean")
    assert [tuple(r) for r in urls.judge(p, o).collect()] == [(1, "a.org", "/", None, "allow")]
    assert urls.judge(p.limit(0), o).collect() == []
