from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.fixture(scope="session")
def vocabulary() -> str:
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and columns whose names clash with results."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "1234 !? 5"), (None, "no number here"), (6, "lorem ipsum dolor sit amet " * 40_000), (7, "Ünïcode 日本語 text here <|endoftext|> x")]
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, source string, n long, kept string, score double")
