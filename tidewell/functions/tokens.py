"""Token ids of a byte-level vocabulary of ranks, as Columns over Arrow batches; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How byte-level vocabularies cut text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    """The encoder of a file of base64 tokens and ranks, one for each worker process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: Column, path: str) -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tool = encoding(path)
        return pd.Series([None if t is None else tool.encode_ordinary(t) for t in texts], dtype=object)

    return run(text)


def count(text: Column, path: str) -> Column:
    return F.size(encode(text, path))


def decode(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        tool = encoding(path)
        return pd.Series([None if r is None else tool.decode(list(r)) for r in rows], dtype=object)

    return run(ids)
