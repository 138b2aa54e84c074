from __future__ import annotations

import hashlib
import random

from tidewell.llm import bpe


def library(path):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def random_texts():
    rng = random.Random(5)
    pools = ["ab c", "aaaaab", "the quick <|endoftext|>", " \n\t x", "'s're it's", "日本語テキスト", "é ü   ​", "0123.,-", "🙂👍 \x00\x85", "<|endoftext|>", "Ab1 ½²", " x y　"]
    texts = ["", " ", "  ", " a", "a ", "a  b", "\n", " \n a", "<|endoftext|>", " <|endoftext|> <|endoftext|>x"]
    for _ in range(600):
        texts.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))))
        texts.append(" ".join(rng.choice(pools) for _ in range(rng.randrange(9))))
    for n in (1023, 1024, 1025, 3000, 20_000):
        texts.append("".join(rng.choice("abcdefghij") for _ in range(n)))
        texts.append("a" * n)
        texts.append("".join(rng.choice("あいう漢字é") for _ in range(n)) + " end")
        texts.append("x" + " " * n + "y\n" * 5)
        texts.append("-=" * n)
    return texts


def test_equal_to_the_library(vocabulary):
    tool, own = library(vocabulary), bpe.codec(vocabulary)
    texts = random_texts()
    for _ in range(2):  # the second time from memory
        ids, off = own.encode_batch(texts)
        for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
            want = tool.encode(t, add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, t[:80]
            assert own.decode(ids[a:b]) == tool.decode(want, skip_special_tokens=False), t[:80]


def test_tree_equals_direct(vocabulary, monkeypatch):
    """Small leaves and windows of a token: every kind of text is cut in every kind of place."""
    monkeypatch.setattr(bpe, "LEAF", 16)
    monkeypatch.setattr(bpe, "WINDOW", 1)
    own, tool, rng = bpe.Codec(vocabulary), library(vocabulary), random.Random(6)
    pools = ["ab c", "aaaaab", "the quick ", " \n\t x", "'s're it's 'rest'", "日本語テキスト。", "é ü", "0123.,-", "🙂👍", "''s'", "----", " x y", "abcdefghijklmnopqrstuvwxyz'"]
    for i in range(3000):
        pool = rng.choice(pools)
        text = "".join(rng.choice(pool if i % 3 else rng.choice(pools)) for _ in range(rng.randrange(300)))
        assert own.ids[own.encode(text)].tolist() == tool.encode(text, add_special_tokens=False).ids, text
    assert own.leaves > 10_000 and own.joins > 10_000


def test_long_texts_of_the_table_go_by_the_tree(spark, vocabulary):
    own = bpe.Codec(vocabulary)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own.encode_batch(texts)
    long = [t for t in texts if len(t) > bpe.LEAF]
    assert len(long) > 50 and own.joins >= len(long) and own.leaves >= 2 * len(long)


def test_other_files_are_read_by_the_library(vocabulary, tmp_path):
    import json

    from tokenizers import Tokenizer

    assert bpe.exact(vocabulary)
    spec = json.load(open(vocabulary, encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec))
    path = f"{tmp_path}/lower.json"
    assert not bpe.exact(path)
    own, tool = bpe.Codec(path), Tokenizer.from_file(path)
    ids, off = own.encode_batch(["Some TEXT here", "", "It'S"])
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [tool.encode(t, add_special_tokens=False).ids for t in ("Some TEXT here", "", "It'S")]
    assert own.decode(ids[: off[1]]) == "some text here"


def test_whole_table_and_odd_rows(spark, vocabulary, odd_docs):
    tool = library(vocabulary)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    got = sorted(tuple(-1 if x is None else x for x in r) for r in bpe.digests(docs, vocabulary).collect())
    want = []
    for doc, text in docs.collect():
        ids = tool.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((-1 if doc is None else doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0), vocabulary).collect() == []
    one = bpe.encode(docs.where("doc_id = 4"), vocabulary).first()
    assert one["ids"] == tool.encode("one two", add_special_tokens=False).ids or one["decoded"]
