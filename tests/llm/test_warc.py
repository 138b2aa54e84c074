from __future__ import annotations

import base64
import hashlib
import os
import time

import pytest

from tidewell.llm import queries, warc


def test_round_trip_and_links(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.derivatives(pages)
    rows = {r["record_id"]: r for r in made.collect()}
    warc.write_warc(made, f"{tmp_path}/warc")
    back = warc.read_warc(spark, f"{tmp_path}/warc/*.gz").collect()
    assert len(back) == 3 * pages.count()
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    for r in back:
        own = rows[r["record_id"]]
        assert sha(bytes(r["block"])) == own["block_digest"] and len(r["block"]) == own["content_length"]
        if r["record_type"] != "response":
            source = rows[r["refers_to"]]
            assert source["record_type"] == "response" and source["page_id"] == own["page_id"] and source["source_payload_digest"] == own["source_payload_digest"]
    for page, url, html in pages.select("page_id", "url", "html").limit(20).collect():
        own = [r for r in rows.values() if r["page_id"] == page and r["record_type"] == "response"]
        assert own[0]["target_uri"] == url and own[0]["source_payload_digest"] == sha(html.encode())


def test_derived_content():
    headers, block = warc.response("http://a.org/x/", "<html lang='EN'><title>A &amp; B</title><script>var a='<p>';</script><p>One<p>two &lt;3<a href='../y'>link</a><!-- no -->")
    meta, plain = warc.derive({k.lower(): v for k, v in headers}, block)
    assert plain[1].decode() == "A & B\nOne\ntwo <3link"
    fields = meta[1].decode().split("\r\n")
    assert "title: A & B" in fields and "language: en" in fields and "outlink: http://a.org/y a/@href" in fields and "http-header-content-type: text/html; charset=utf-8" in fields
    assert dict(plain[0])["WARC-Concurrent-To"] == dict(meta[0])["WARC-Record-ID"]


def test_open_tags_take_linear_time():
    for piece in ("<a x ", "<title>", "<title ", "<html x ", "<script ", "<script>", "<!-- ", "<img src='", "<p ", "</script "):
        began = time.perf_counter()
        headers, block = warc.response("http://a.org/", piece * (1_000_000 // len(piece)))
        warc.derive({k.lower(): v for k, v in headers}, block)
        assert time.perf_counter() - began < 5, piece


def test_odd_markup():
    assert warc.text_of("a <!-- b --> c <script x>1<2</script >d <style>e") == "a c d"
    assert warc.text_of("1 <b>2</b> <i 3") == "1 2 <i 3" and warc.text_of("a <script b <!-- c") == "a <script b"
    assert list(warc.links_of('<a class=x href="a>b"><img alt=1 src=c><a href=\'d\'><area href = e >')) == [("a", "href", "a>b"), ("img", "src", "c"), ("a", "href", "d"), ("area", "href", "e")]
    assert warc.title_of("<title x>A &lt; B</title>") == "A < B" and warc.title_of("<title>A") is None
    ids = {warc.response("u", "same", key=k)[0][1][1] for k in ("1", "2", "")}
    assert len(ids) == 3


def plain_derivation(page, url):
    """Title, links and text of a page by the standard library's parser."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.links, self.words, self.inside = [], [], []

        def handle_starttag(self, tag, attrs):
            found = [v for n, v in attrs if n in ("href", "src")]
            if tag in ("a", "area", "img", "link", "iframe", "script") and found:
                self.links.append(urljoin(url, found[0].strip()))
            if tag in ("script", "style", "noscript", "template"):
                self.inside.append(tag)

        def handle_endtag(self, tag):
            if self.inside and self.inside[-1] == tag:
                self.inside.pop()

        def handle_data(self, data):
            if not self.inside:
                self.words.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return reader.links, "".join(reader.words).split()


def test_derivation_against_a_parser(spark):
    made = {(r["page_id"], r["record_type"]): r["block"] for r in warc.derivatives(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for page, url, html in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect():
        links, words = plain_derivation(html or "", url or "")
        fields = [x.partition(": ") for x in made[page, "metadata"].split("\r\n")]
        assert [v.rpartition(" ")[0] for k, _, v in fields if k == "outlink"] == links
        assert "".join(made[page, "conversion"].split()) == "".join("".join(words).split())


def test_truncated_and_foreign_files():
    headers, block = warc.response("http://a.org/", "x")
    data = warc.write_record(headers, block)
    assert [b for _, b in warc.read_records(data * 2)] == [block, block]
    for broken in (data[: len(data) // 2 + 150], b"no warc at all\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(broken))


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "", "", "y"), (3, "http://a\r\nb", "<p>" * 50_000, "z"), (3, "http://a\r\nb", "<p>" * 50_000, "z"), (None, "u", "t", "w")], "page_id long, url string, html string, block string")
    assert warc.derivatives(pages).count() == 15
    assert warc.derivatives(pages.limit(0)).collect() == []
    assert os.linesep


def test_query_returns_whole_records(spark):
    rows = queries.op2_warc(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 3 * spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    for r in rows:
        ((headers, block),) = warc.read_records(bytes(r["record"]))
        assert headers["warc-record-id"] == r["record_id"] and len(block) == r["content_length"]
        assert r["block"] == (None if r["record_type"] == "response" else block.decode())
