"""Whole-file documents, Markdown trees, JSON lines, reports, rules, catalogs and settings, through Spark's own readers and writers.

Paths may lie in any store that Spark reads; what is small by nature
(rules, settings, one report) is read as text and parsed on the driver.
"""

from __future__ import annotations

import json
import re
import sys
import tomllib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Names of files that are made by reports or stand as templates; fixed values.
GENERATED = ("stats", "report", "scorecard", "template", "_template", "README")
CHAPTER = r"(\d+)"
FEEDBACK = ("conflict_key", "category", "story", "title", "entity_category", "summary", "decision", "facet", "note", "updated_at")


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, text): each file whole; ``-`` is the standard input, read once on the driver."""
    files = [p for p in paths if p != "-"]
    schema = "path string, text string"
    out = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")) if files else spark.createDataFrame([], schema)
    if "-" in paths:
        out = out.unionByName(spark.createDataFrame([("-", sys.stdin.read())], schema))
    return out.select(T.content_id("doc-", F.col("text")).alias("doc_id"), "path", "text")


def tree(spark: SparkSession, root: str, pattern: str = "*.md", generated: bool = False) -> DataFrame:
    """(path, text) of all files below root that fit the pattern, once each; generated files and templates only if asked for."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])
    return files if generated else files.where(is_target(F.col("path")))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def is_target(path: Column) -> Column:
    return ~F.rlike(name_of(path), F.lit(rf"(?i)(^|[-_.])({'|'.join(GENERATED)})$"))


def chapter_order(path: Column) -> Column:
    """The number in the file's name; files without one come last."""
    found = F.regexp_extract(name_of(path), CHAPTER, 1)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(9999))


def chapters(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, number) of a tree, to be sorted by folder, number and path."""
    return tree(spark, root).withColumn("number", chapter_order(F.col("path")))


def classified(path: Column, root: str) -> Column:
    """(doc_type, arc, story, chapter) of a path below root: its first folder, first arcN, last storyN or interludeN, and the file's chapterN."""
    rest = F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    named = lambda p, at: F.nullif(F.regexp_extract(at, p, 1), F.lit(""))
    stories = F.regexp_extract_all(rest, F.lit(r"(?:^|/)((?:story|interlude)\d+)(?=/)"), 1)
    story = F.coalesce(F.element_at(F.when(F.size(stories) > 0, stories), -1), named(r"((?:story|interlude)\d+)[^/]*$", rest))
    return F.struct(F.split_part(rest, F.lit("/"), F.lit(1)).alias("doc_type"), named(r"(?:^|/)(arc\d+)(?=/|[^/]*$)", rest).alias("arc"), story.alias("story"), named(r"(chapter\d+|ch\d+)[^/]*$", rest).alias("chapter"))


def passages(text: Column) -> Column:
    """(line_start, line_end, text) of the stretches between blank lines; lines count from 1."""
    lines = F.split(text, "\n")
    at = F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), T.trimmed(l).alias("t"), l.alias("l")))
    zero = F.array().cast("array<struct<line_start:int,line_end:int,text:string>>")
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["line_start"].alias("line_start"), x["n"].alias("line_end"), F.concat(F.element_at(acc, -1)["text"], F.lit("\n"), x["l"]).alias("text"))))
    fresh = lambda acc, x: F.concat(acc, F.array(F.struct(x["n"].alias("line_start"), x["n"].alias("line_end"), x["l"].alias("text"))))
    return F.aggregate(at, zero, lambda acc, x: F.when(x["t"] == "", acc).when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["line_end"] == x["n"] - 1), grown(acc, x)).otherwise(fresh(acc, x)))


def headings(docs: DataFrame) -> DataFrame:
    """(path, line, level, title) of the Markdown headings of (path, text)."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    mark = F.regexp_extract("l", r"^(#{1,6})\s+(.*?)\s*$", 1)
    return lines.where(mark != "").select("path", (F.col("line") + 1).alias("line"), F.length(mark).alias("level"), F.regexp_extract("l", r"^(#{1,6})\s+(.*?)\s*$", 2).alias("title"))


def sections(docs: DataFrame) -> DataFrame:
    """(path, section, line, body): the text below each heading up to the next; what stands before the first has a null section."""
    # the marks themselves stay in the pieces, so that each piece names its own section
    pieces = docs.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,6}\s)")).alias("at", "piece"))
    title = F.nullif(F.regexp_extract("piece", r"^#{1,6}\s+(.*?)\s*(?:\n|$)", 1), F.lit(""))
    return pieces.select("path", "at", title.alias("section"), T.trimmed(F.regexp_replace("piece", r"^#{1,6}\s[^\n]*", "")).alias("body")).where("section IS NOT NULL OR body <> ''")


def bullets(body: Column) -> Column:
    return F.transform(F.filter(F.split(body, "\n"), lambda l: F.rlike(l, F.lit(r"^\s*[-*+]\s+\S"))), lambda l: F.regexp_replace(l, r"^\s*[-*+]\s+|\s+$", ""))


def cards(docs: DataFrame) -> DataFrame:
    """(path, category, title, fields, aliases) of concept cards: the first heading, ``- key: value`` lines, and the names in the alias field."""
    pair = r"^\s*[-*]\s*([^:：\n]+?)\s*[:：][ \t]*(.*?)\s*$"
    lines = F.filter(F.split("text", "\n"), lambda l: F.rlike(l, F.lit(pair)))
    fields = F.map_from_entries(F.transform(lines, lambda l: F.struct(F.regexp_extract(l, pair, 1).alias("k"), F.regexp_extract(l, pair, 2).alias("v"))))
    first = F.filter(F.transform(F.split("text", "\n"), lambda l: F.regexp_extract(l, r"^#\s+(.*?)\s*$", 1)), lambda t: t != "")
    return docs.select("path", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("category"), F.coalesce(F.get(first, F.lit(0)), name_of(F.col("path"))).alias("title"), _last_wins(lines, fields).alias("fields")).withColumn("aliases", names_of(F.coalesce(F.element_at("fields", "aliases"), F.element_at("fields", "别名"), F.lit(""))))


def _last_wins(lines: Column, fields: Column) -> Column:
    """Keys of cards repeat; the value of the last one stays."""
    pair = r"^\s*[-*]\s*([^:：\n]+?)\s*[:：][ \t]*(.*?)\s*$"
    return F.aggregate(lines, F.create_map().cast("map<string,string>"), lambda m, l: F.map_concat(F.map_filter(m, lambda k, _: k != F.regexp_extract(l, pair, 1)), F.create_map(F.regexp_extract(l, pair, 1), F.regexp_extract(l, pair, 2))))


def names_of(value: Column) -> Column:
    """Names between commas, slashes and enumeration marks, once each."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"[,，、/;；|]"), T.trimmed), lambda n: n != ""))


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines with all values as text, in their order (seq); nulls are dropped, as are lines that aren't objects."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value"))
    values = F.from_json("value", "map<string,string>")
    return lines.withColumn("v", values).where("v IS NOT NULL").select("seq", *[F.element_at("v", k).alias(k) for k in FEEDBACK])


def append_feedback(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines with keys in their fixed order; nulls are left out."""
    rows.select(F.to_json(F.struct(*[k for k in FEEDBACK if k in rows.columns])).alias("value")).write.mode("append").text(path)


def report(rows: DataFrame, path: str, title: str | None = None) -> None:
    """A report's rows as JSON lines or, with a title, as one Markdown table; a report is small by nature."""
    if title is None:
        rows.coalesce(1).write.mode("overwrite").json(path)
        return
    rows.sparkSession.createDataFrame([(markdown(rows, title),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, title: str) -> str:
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    shown = lambda v: "" if v is None else re.sub(r"\s+", " ", str(v)).replace("|", "\\|")
    return "\n".join([f"# {title}", "", *head, *("| " + " | ".join(map(shown, r)) + " |" for r in rows.toLocalIterator())]) + "\n"


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def settings(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """TOML settings over the defaults, table by table."""

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return over(defaults or {}, tomllib.loads(_text(spark, path)))


RULES = "section string, name string, label string, pattern string, note string, register string, max_per_10k double"


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a rules file: lists of rules by section, in JSON or in the plain subset of YAML that ``plain_yaml`` reads."""
    data = _text(spark, path)
    found = json.loads(data) if data.lstrip().startswith("{") else plain_yaml(data)
    rows = [(s, r["name"], r.get("label"), r["pattern"], r.get("note", ""), r.get("register", ""), float(r.get("max_per_10k", 0))) for s, own in found.items() if isinstance(own, list) for r in own if isinstance(r, dict)]
    for row in rows:
        re.compile(row[3])
    return spark.createDataFrame(rows, RULES)


def plain_yaml(text: str) -> dict:
    """Mappings, lists and scalars by indentation; flow collections are JSON. Anchors, tags and block texts are errors."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    def scalar(s: str):
        if s[:1] in "[{\"":
            return json.loads(s)
        if s[:1] == "'" and s[-1:] == "'":
            return s[1:-1].replace("''", "'")
        if s[:1] in ("&", "*", "!", "|", ">"):
            raise ValueError(f"unsupported: {s}")
        return {"true": True, "false": False, "null": None, "~": None}.get(s, int(s) if re.fullmatch(r"-?\d+", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s)

    def block(i: int, depth: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out: list | dict = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1][:1] == "-":
                rest = lines[i][1][1:].strip()
                if re.match(r"[\w.-]+:(\s|$)", rest):
                    lines[i] = (depth + 2, rest)
                    value, i = block(i, depth + 2)
                else:
                    value, i = scalar(rest), i + 1
                out.append(value)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == depth and lines[i][1][:1] != "-":
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip():
                out[key.strip()] = scalar(rest.strip())
            elif i < len(lines) and (lines[i][0] > depth or lines[i][0] == depth and lines[i][1][:1] == "-"):
                out[key.strip()], i = block(i, lines[i][0])
            else:
                out[key.strip()] = None
        return out, i

    if not lines:
        return {}
    found, end = block(0, lines[0][0])
    if end != len(lines) or not isinstance(found, dict):
        raise ValueError(f"line {end + 1} isn't understood")
    return found


def write_rules(new: DataFrame, old: DataFrame, path: str) -> None:
    """The old rules with those of new in place of equal (section, name), as JSON by section."""
    merged = old.join(new.select("section", "name"), ["section", "name"], "left_anti").unionByName(new)
    out: dict[str, list] = {}
    for r in merged.orderBy("section", "name").toLocalIterator():
        row = {k: v for k, v in r.asDict().items() if v is not None and k != "section"}
        out.setdefault(r["section"], []).append(row)
    new.sparkSession.createDataFrame([(json.dumps(out, ensure_ascii=False, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def catalog(spark: SparkSession, path: str, needed: Iterable[str] = ("template_candidates", "term_candidates")) -> dict:
    """A catalog in JSON or plain YAML; a missing list is an error."""
    data = _text(spark, path)
    found = json.loads(data) if data.lstrip().startswith("{") else plain_yaml(data)
    for key in needed:
        if not isinstance(found.get(key), list):
            raise ValueError(f"the catalog has no list {key}")
    return found


SESSION = "session_id string, task_id string, turns array<struct<turn_id:string,role:string,content:string,timestamp:bigint>>, episodes array<struct<key:string,text:string>>, rules array<struct<key:string,text:string,from:array<string>>>, procedures array<struct<key:string,text:string,from:array<string>>>"


def sessions(lines: DataFrame) -> DataFrame:
    """Session records of JSON lines (value); a line that isn't one is an error."""
    return lines.select(F.from_json("value", SESSION, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def slices(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(case_id, conversation_id, turn_id, role, content, timestamp, evidence) of a benchmark slice: ``turns`` has a flat list, ``sessions`` dated sessions."""
    if kind == "turns":
        schema = "case_id string, conversation_id string, turns array<struct<turn_id:string,speaker:string,content:string,timestamp:bigint>>, query struct<gold_turn_id:string>"
        raw = spark.read.schema(schema).json(path, multiLine=True)
        t = raw.select("case_id", "conversation_id", F.col("query.gold_turn_id").alias("gold"), F.explode("turns").alias("t"))
        return t.select("case_id", "conversation_id", "t.turn_id", F.when(F.col("t.speaker") == "agent", "assistant").otherwise(F.col("t.speaker")).alias("role"), "t.content", "t.timestamp", (F.col("t.turn_id") == F.col("gold")).alias("evidence"))
    if kind != "sessions":
        raise ValueError("a slice has turns or sessions")
    schema = "sessions array<struct<session_id:string,date:string,turns:array<struct<role:string,content:string,evidence:boolean>>>>, query struct<question_id:string>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    s = raw.select(F.col("query.question_id").alias("case_id"), F.explode("sessions").alias("s"))
    t = s.select("case_id", F.col("s.session_id").alias("conversation_id"), session_time(F.col("s.date")).alias("at"), F.posexplode("s.turns").alias("i", "t"))
    return t.select("case_id", "conversation_id", F.concat("conversation_id", F.lit("-"), F.col("i").cast("string")).alias("turn_id"), "t.role", "t.content", (F.col("at") + F.col("i") * 1000).alias("timestamp"), F.coalesce("t.evidence", F.lit(False)).alias("evidence"))


def session_time(date: Column) -> Column:
    """Milliseconds of ``2023/05/30 (Tue) 21:40``; null for other texts."""
    part = lambda i: F.regexp_extract(date, r"^(\d{4})/(\d{2})/(\d{2}) \(\w{3}\) (\d{2}):(\d{2})$", i)
    ok = part(1) != ""
    day = F.try_make_timestamp(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("int"), F.lit(0))
    return F.when(ok, F.unix_millis(day))
