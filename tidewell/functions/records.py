"""Tuple-delimited records, names, templates, lenient JSON and keys as Columns; what built-in functions can't express runs on Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType

from . import text as T

#: Delimiters of records, of the end of a record list and of joined fields; fixed values.
TUPLE, COMPLETE, SEP = "<|#|>", "<|COMPLETE|>", "<SEP>"
UNKNOWN_SOURCE = "unknown_source"
#: Types that no entity may have; fixed values.
RESERVED = ("__proto__", "constructor", "prototype")
_HAN = "一-龥"
_NEAR = r"a-zA-Z0-9()\[\]@#$%!&*\-=+_"
_WIDE = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)])) + "—－＋／＊（）　"
_PLAIN = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "--+/*() "
#: A letter, then letters, digits, blanks and marks, at last a letter or digit: what normalisation leaves as it is.
_BARE = r"^[A-Za-z](?:[A-Za-z0-9 _.,:;/-]*[A-Za-z0-9])?\z"


def normalized(value: Column, inner_quotes: bool = False) -> Column:
    """A name or description: entities resolved, controls, breaks and outer quotes gone, wide letters folded, blanks beside Han letters closed.

    inner_quotes: typographic quotes and those beside Han letters go too.  One
    or two digits alone, and up to five digits and dots, give the empty string.
    """
    out = T.trimmed(T.clean(value))
    out = F.translate(F.regexp_replace(out, r"(?i)</?p\s*/?>|</?br\s*/?>", ""), _WIDE, _PLAIN)
    out = F.regexp_replace(out, rf"(?<=[{_HAN}])\s+(?=[{_HAN}{_NEAR}])|(?<=[{_NEAR}])\s+(?=[{_HAN}])", "")
    for a, b in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")):
        out = F.regexp_replace(out, f"(?s)^{a}([^{a}{b}]*){b}$", "$1")
    if inner_quotes:
        out = F.translate(F.translate(out, "“”‘’", ""), "  ", "  ")
        out = F.regexp_replace(out, rf"""['"]+(?=[{_HAN}])|(?<=[{_HAN}])['"]+""", "")
    out = F.regexp_replace(T.trimmed(out), r"^(?:[0-9]{0,2}|(?=[0-9.]*\.)[0-9.]{1,5})$", "")
    return F.when(F.rlike(value, F.lit(_BARE)), value).otherwise(out)


def entity_type(raw: Column) -> Column:
    """The first filled part between commas, without blanks, in lower case; null if there is none, or for structural characters and reserved names."""
    first = F.when(F.contains(raw, F.lit(",")), F.get(F.filter(F.transform(F.split(raw, ","), T.trimmed), lambda t: t != ""), F.lit(0))).otherwise(raw)
    kind = F.lower(F.replace(first, F.lit(" "), F.lit("")))
    return F.when((T.trimmed(raw) != "") & ~F.rlike(raw, F.lit(r"""['()<>|/\\]""")) & ~kind.isin(*RESERVED), kind)


def _marked(row: Column, kind: str) -> Column:
    return F.when(row.startswith("entity") | row.startswith("relation"), row).otherwise(F.concat(F.lit(kind + TUPLE), row))


def repaired(record: Column) -> Column:
    """The rows of a record that holds several: cut at entity and relation marks, and each given the mark that it lost."""
    entities = F.transform(T.split_markers(record, (f"{TUPLE}entity{TUPLE}",)), lambda r: _marked(r, "entity"))
    parts = F.transform(entities, lambda r: F.transform(T.split_markers(r, (f"{TUPLE}relationship{TUPLE}", f"{TUPLE}relation{TUPLE}")), lambda x: _marked(x, "relation")))
    return F.flatten(parts)


def rows(raw: Column) -> Column:
    """All rows of an extraction result, in order: records end at line ends and at the completion mark."""
    return F.flatten(F.transform(T.split_markers(raw, ("\n", COMPLETE, COMPLETE.lower())), repaired))


def attributes(row: Column) -> Column:
    """The fields of a row; five fields marked as an entity are a relation."""
    fields = T.split_markers(row, (TUPLE,))
    mark = F.lower(F.get(fields, F.lit(0)))
    wrong = (F.size(fields) == 5) & F.contains(mark, F.lit("entity")) & ~F.contains(mark, F.lit("relation"))
    return F.when(wrong, F.concat(F.array(F.lit("relation")), F.slice(fields, 2, 4))).otherwise(fields)


def is_float(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^[-+]?[0-9]*\.?[0-9]+$"))


def relation_key(a: Column, b: Column) -> Column:
    """Both names in order, joined."""
    return F.concat_ws(SEP, F.least(a, b), F.greatest(a, b))


def relation_ends(key: Column) -> Column:
    """The two names of a key; null if it isn't one."""
    parts = F.split(key, re.escape(SEP))
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("src"), F.get(parts, F.lit(1)).alias("tgt")))


def cell(value: Column, number: bool = False) -> Column:
    """A table cell: numbers bare, text stripped of outer quotes and quoted."""
    return value.cast("string") if number else F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(T.trimmed(value), "^'+|'+$", ""), '^"+|"+$', ""), F.lit('"'))


def csv_row(*cells: Column) -> Column:
    return F.concat_ws(",\t", *cells)


def vector_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.concat(*parts)))


def embedding_key(ws: Column, sess: Column, task: Column, model: str, text: Column) -> Column:
    """Cache key of a fact's embedding."""
    return F.concat(F.lit("evf-"), F.md5(F.concat_ws("\u001f", ws, F.coalesce(sess, F.lit("")), F.coalesce(task, F.lit("")), F.lit(model), text)))


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """Distinct 64-bit hashes of the runs of k words; of all words if there are fewer."""
    return F.transform(T.shingles(words, k), lambda s: F.xxhash64(s))


def fnv1a(text: str) -> int:
    """64-bit FNV-1a of the text's UTF-8 bytes; a fixed rule."""
    out = 0xCBF29CE484222325
    for b in text.encode():
        out = (out ^ b) * 0x100000001B3 % (1 << 64)
    return out


def _mapped(kind: DataType, f: Callable) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    return run


def python_float(value: float) -> str:
    """The shortest text of a double, whole ones with one decimal."""
    return f"{value:.1f}" if value == value and abs(value) != float("inf") and value == int(value) else str(value)


def rounded(value: float, digits: int = 2) -> float:
    """Half to even on the exact binary value, so that 2.675 gives 2.67."""
    return round(value, digits)


def first_json(text: str) -> str | None:
    """The first balanced braces as JSON text without line ends; null if none are or they don't parse."""
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "{":
            start, depth = (i if start < 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    return json.dumps(json.loads(text[start : i + 1].replace("\n", "")), ensure_ascii=False, sort_keys=True)
                except ValueError:
                    return None
    return None


_PAIR = re.compile(r'"?(\w+)"?\s*:\s*(\{[^}]*\}|".*?"|[^,}]+)', re.S)


def lenient_scalar(text: str):
    text = text.strip()
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text.strip('"')


def lenient_json(text: str) -> dict:
    """Keys and values of text that only looks like JSON; braces are read in turn."""
    pairs = [(k, v.strip()) for k, v in _PAIR.findall(text)]
    return {k: lenient_json(v) if v.startswith("{") and v.endswith("}") else lenient_scalar(v) for k, v in pairs}


def response_json(text: str) -> str | None:
    """JSON of a response: the first whole object, else what can be read of it, null if nothing can."""
    return first_json(text) or (json.dumps(x, ensure_ascii=False, sort_keys=True) if (x := lenient_json(text)) else None)


def keyword_lists(text: Column, first: str = "high_level_keywords", second: str = "low_level_keywords") -> Column:
    """Both lists of keywords of a JSON object that has just these two keys, each a list of texts; else null."""
    keys = F.json_object_keys(text)
    get = lambda k: F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>")
    fits = (F.size(keys) == 2) & F.array_contains(keys, first) & F.array_contains(keys, second) & get(first).isNotNull() & get(second).isNotNull()
    return F.when(fits, F.struct(get(first).alias("high"), get(second).alias("low")))


def filled(template: str, values: dict[str, str]) -> str:
    """The template with {name} replaced and doubled braces halved; an unknown name is an error, an unclosed brace stays."""

    def put(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        if m[1] not in values:
            raise KeyError(f"unknown placeholder {{{m[1]}}}")
        return values[m[1]]

    return re.sub(r"\{\{|\}\}|\{([^}]*)\}", put, template)


def filled_column(template: str, **values: Column) -> Column:
    """filled() as one concatenation."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([^}]*)\}", template):
        parts += [F.lit(template[at : m.start()]), F.lit(m[0][0]) if m[0] in ("{{", "}}") else values[m[1]]]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def call_hash(model: str, messages: list[dict[str, str]]) -> str:
    """md5 of the printed pair of model and messages, the cache key of a model call."""

    def shown(s: str) -> str:
        quote = '"' if "'" in s and '"' not in s else "'"
        named = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", quote: "\\" + quote}
        return quote + "".join(named.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in s) + quote

    inner = ", ".join(f"{{'role': {shown(m['role'])}, 'content': {shown(m['content'])}}}" for m in messages)
    return hashlib.md5(f"({shown(model)}, [{inner}])".encode()).hexdigest()


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def snapshot_hash(value) -> str:
    return hashlib.md5(canonical_json(value).encode()).hexdigest()


first_json_column, response_json_column = _mapped(StringType(), first_json), _mapped(StringType(), response_json)
float_text_column, rounded_column, fnv1a_text_column = _mapped(StringType(), python_float), _mapped(DoubleType(), rounded), _mapped(StringType(), lambda t: f"{fnv1a(t):016x}")
