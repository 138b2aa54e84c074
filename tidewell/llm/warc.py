"""WARC records: responses from pages, and the metadata and plain-text conversion records derived from them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

Headers = list[tuple[str, str]]
#: The date of responses that are made from pages, which have none.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DROPPED = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "title")}
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LINKED = re.compile(r"<(a|area|img|link|iframe|script)\b", re.I)
_PLACE = re.compile(r"\s(href|src)\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)")
_TITLE, _HTML = re.compile(r"<title\b", re.I), re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*what: str) -> str:
    """An id that the same content always gets, so that a task run again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(what))}>"


def _line(text: str) -> str:
    """One header line's worth of text."""
    return re.sub(r"[\r\n]+", " ", text).strip()


def write_record(headers: Headers, block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in headers)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, gzipped or not; a truncated end is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, str] = {}
        last = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and last:
                headers[last] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                last = name.strip().lower()
                headers[last] = value.strip()
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is truncated")
        yield headers, block
        at = end + 4 + size


def http_parts(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])], body if gap else b""


def response(url: str, page: str, date: str = DATE, key: str = "") -> tuple[Headers, bytes]:
    """The response record of a page; key tells pages of the same content apart."""
    body = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    payload = digest(body)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, date, payload, key)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return headers, block


def undressed(page: str, blank: bool) -> str:
    """The page without comments, scripts and styles, each a space if blank; else their opening tags stay.

    All scans here go forward only, so that pages of open tags take linear time.
    """
    out, at = [], 0
    while m := _DROPPED.search(page, at):
        opened = page.find(">", m.end()) + 1 if m[1] else m.end()
        if not opened:  # no tag ends after this place, so only a comment can be dropped
            last = page.find("<!--", m.end())
            return "".join(out) + page[at : last if last >= 0 else len(page)]
        closed = _CLOSED[m[1].lower()].search(page, opened) if m[1] else None
        end = closed.end() if closed else page.find("-->", opened) + 3 if not m[1] and page.find("-->", opened) >= 0 else len(page)
        out += [page[at : m.start()], " " if blank or not m[1] else page[m.start() : opened]]
        at = end
    return "".join(out) + page[at:]


def text_of(page: str) -> str:
    """Plain text of a page: scripts, styles, comments and tags go, blocks end lines, entities are resolved, blanks are folded."""
    text = undressed(page.replace("\n", " "), True)
    last = text.rfind(">") + 1
    text = _TAG.sub("", _BREAK.sub("\n", text[:last])) + text[last:]
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def title_of(shown: str) -> str | None:
    """What stands in the first title tag that is closed."""
    m = _TITLE.search(shown)
    opened = shown.find(">", m.end()) + 1 if m else 0
    closed = _CLOSED["title"].search(shown, opened) if opened else None
    return _BLANK.sub(" ", html.unescape(shown[opened : closed.start()])) if closed else None


def language_of(shown: str) -> str | None:
    at = 0
    while (m := _HTML.search(shown, at)) and (at := shown.find(">", m.end())) >= 0:
        if found := _LANG.search(shown, m.end(), at):
            return found[1].lower()
    return None


def links_of(shown: str) -> Iterator[tuple[str, str, str]]:
    """Tag, attribute and raw value of the first link of each tag."""
    at = 0
    while (m := _LINKED.search(shown, at)) and (at := shown.find(">", m.end())) >= 0:
        if (place := _PLACE.search(shown, m.end(), at)) and (value := _VALUE.match(shown, place.end())):
            yield m[1].lower(), place[1].lower(), next(x for x in value.groups() if x is not None)
            at = max(at, value.end())


def charset_of(content_type: str) -> str:
    m = re.search(r"charset\s*=\s*\"?([\w.:-]+)", content_type, re.I)
    try:
        return "".encode(m[1]) is not None and m[1] if m else "utf-8"
    except LookupError:
        return "utf-8"


def derive(source: dict[str, str], block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response record (headers by lower-case name).

    Both refer to the response and carry its target, date and digests; the
    metadata block has title, language, outlinks and the response's own HTTP
    headers; the conversion refers to the metadata as well.
    """
    status, http, body = http_parts(block)
    kind = next((v for n, v in http if n.lower() == "content-type"), "")
    page = body.decode(charset_of(kind), "replace")
    target, date, of = source.get("warc-target-uri", ""), source.get("warc-date", DATE), source.get("warc-record-id", "")
    payload = source.get("warc-payload-digest") or digest(body)
    shown = undressed(page, False)
    fields: Headers = [("http-status", status), *((f"http-header-{n.lower()}", v) for n, v in http)]
    if (title := title_of(shown)) is not None:
        fields.append(("title", title))
    if language := language_of(shown):
        fields.append(("language", language))
    for tag, attribute, value in links_of(shown):
        link = html.unescape(value).strip()
        try:
            fields.append(("outlink", f"{urljoin(target, link)} {tag}/@{attribute}"))
        except ValueError:
            fields.append(("outlink", f"{link} {tag}/@{attribute}"))
    out = []
    meta = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode()
    plain = text_of(page).encode("utf-8", "replace")
    linked: Headers = []
    for kind, content, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain)):
        own = record_id(kind, of, target, date, payload)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", of), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), *linked,
                   ("WARC-Source-Payload-Digest", payload), ("WARC-Source-Block-Digest", source.get("warc-block-digest") or digest(block)), ("WARC-Block-Digest", digest(data)), ("Content-Type", content), ("Content-Length", str(len(data)))]
        out.append((headers, data))
        linked = [("WARC-Concurrent-To", own)]
    return out


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, source_payload_digest string, block_digest string, content_type string, content_length long, n_outlinks long, block string, record binary"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def derivatives(pages: DataFrame, with_blocks: bool = True) -> DataFrame:
    """The response, metadata and conversion record of each row of (page_id, url, html).

    A null url or html counts as empty; a page without text has an empty
    conversion; repeated rows give equal records, equal pages of other numbers
    records with ids of their own; an empty table gives none;
    more columns are ignored, whatever their names.  with_blocks: also the
    block as text (derived records only) and the whole record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            rows: dict[str, list] = {c: [] for c in _COLUMNS}
            for page, url, text in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                first = response(_line(url or ""), text or "", key="" if page is None else str(page))
                for headers, block in [first, *derive({k.lower(): v for k, v in first[0]}, first[1])]:
                    h = {k.lower(): v for k, v in headers}
                    derived = h["warc-type"] != "response"
                    values = (page, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h["warc-target-uri"], h["warc-date"], h.get("warc-source-payload-digest") or h.get("warc-payload-digest"), h["warc-block-digest"], h["content-type"], len(block),
                              block.count(b"outlink: ") if h["warc-type"] == "metadata" else 0, block.decode() if with_blocks and derived else None, write_record(headers, block) if with_blocks else None)
                    for c, v in zip(_COLUMNS, values, strict=True):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.binary() if c == "record" else pa.int64() if c in ("page_id", "content_length", "n_outlinks") else pa.string()) for c in _COLUMNS]))

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def write_warc(records: DataFrame, folder: str, compression: str | None = "gzip") -> None:
    """Write the column record as WARC files, one for each task, through Spark's own writer and so to any store.

    A record ends with the two line ends that the writer puts after each row.
    """
    body = F.expr("substring(record, 1, length(record) - 4)").cast("string")
    writer = records.select(body.alias("value")).write.option("lineSep", "\r\n\r\n")
    (writer.option("compression", compression) if compression else writer).text(folder)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, position, record_type, record_id, refers_to, target_uri, date, block of every record of the files at path; a file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, (h, block) in enumerate(read_records(data)):
                    yield pa.RecordBatch.from_pydict({"path": [place], "position": pa.array([i], pa.int64()), **{c: pa.array([h.get(n)], pa.string()) for c, n in (("record_type", "warc-type"), ("record_id", "warc-record-id"), ("refers_to", "warc-refers-to"), ("target_uri", "warc-target-uri"), ("date", "warc-date"))}, "block": [block]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, position long, record_type string, record_id string, refers_to string, target_uri string, date string, block binary")
