"""Text functions as Columns: ids, clean-up, tokens, sentences, screens and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that html_unescape resolves, whatever their case, beside numeric ones; fixed values.
ENTITIES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"))
_ENTITY = r"(?i)&(?:amp|lt|gt|quot|apos|nbsp|#x\+?[0-9a-f]+|#\+?[0-9]+);"
#: Kinds of credentials and their patterns; fixed values.
CREDENTIALS = (
    ("sk_key", r"sk-[A-Za-z0-9]{20,}"),
    ("ghp_token", r"ghp_[A-Za-z0-9]{36}"),
    ("xox_token", r"xox[baprs]-[A-Za-z0-9-]+"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("assignment", r"""(password|passwd|secret|api[_-]?key)\s*[:=]\s*["']?[^\s"']{8,}"""),
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_id(prefix: str, text: Column) -> Column:
    """prefix and the md5 of the trimmed text."""
    return F.concat(F.lit(prefix), F.md5(trimmed(text)))


def _resolved(entity: Column) -> Column:
    """What an entity that the pattern found stands for; itself if its number is no character."""
    name = F.lower(F.substring(entity, 2, F.char_length(entity) - 2) if isinstance(entity, str) else entity.substr(F.lit(2), F.char_length(entity) - 2))
    number = F.when(name.startswith("#x"), F.conv(F.regexp_replace(name, r"^#x\+?0*", "0"), 16, 10).cast("decimal(38,0)")).when(name.startswith("#"), F.regexp_replace(name, r"^#\+?0*(.{0,30}).*", "0$1").cast("decimal(38,0)"))
    valid = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).cast("long")), 8, "0")), "UTF-32")
    out = F.when(valid, char)
    for known, value in ENTITIES:
        out = out.when(name == known, F.lit(value))
    return out.otherwise(entity)


def html_unescape(text: Column) -> Column:
    """Named and numeric entities resolved in one pass from left to right, so that nothing is resolved twice."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), 0), _resolved)
    parts = F.zip_with(F.split(text, _ENTITY), found, lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def clean(text: Column) -> Column:
    """Trimmed, unescaped, without control characters."""
    return F.regexp_replace(html_unescape(trimmed(text)), r"[\x00-\x1f\x7f-\x9f]", "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap(query: Column, found: Column) -> Column:
    """Share of the query's tokens that were found; 0 for a query without tokens."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, found)) / F.size(query)).otherwise(F.lit(0.0))


def split_markers(text: Column, markers: tuple[str, ...]) -> Column:
    """Trimmed non-empty pieces between any of the literal markers."""
    import re
    from functools import reduce

    # split() compiles its pattern for each text, so only texts with a marker go there; most pieces have nothing to trim
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])
    pieces = F.when(marked, F.split(text, "|".join(map(re.escape, markers)))).when(text.isNotNull(), F.array(text))
    return F.filter(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(r"(?s)^[!-~](?:.*[!-~])?\z")), p).otherwise(trimmed(p))), lambda p: p != "")


def folded_space(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def summary(text: Column, chars: int = 200) -> Column:
    return F.substring(text, 1, chars)


def sentences(text: Column) -> Column:
    """Trimmed non-empty pieces that end at a full stop, question or exclamation mark or line end."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), trimmed), lambda s: s != "")


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words; all words as one if there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n >= k, F.array_distinct(runs)).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def credential_kinds(text: Column) -> Column:
    """Names of the credential patterns that the text matches, in their order."""
    return F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(n)) for n, p in CREDENTIALS]))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of equal length; 0 where a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def md5_bucket(token: Column, buckets: int = 64) -> Column:
    """The first 8 bytes of the md5, as a number, modulo buckets: a power of two up to 256, so the eighth byte alone decides."""
    if buckets not in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("buckets is a power of two up to 256")
    return F.pmod(F.conv(F.substring(F.md5(token), 15, 2), 16, 10).cast("long"), F.lit(buckets))


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """(start, tokens) of windows of size tokens, each overlap tokens into the one before; one that holds nothing but overlap is kept."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the window")
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, F.lit(size)).alias("tokens")))
