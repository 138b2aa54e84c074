from __future__ import annotations

import hashlib

import corpus_pipeline
from tidewell.llm import decontaminate, pii

from .test_near_dedup import brute


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "near-duplicate removal", "benchmark decontamination", "redaction of personal data", "BPE encoding"]


def test_run_against_brute_force(spark, vocabulary):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = corpus_pipeline.identify_language(spark, docs, folder)
    assert told.columns == docs.columns and told.count() > 0.95 * docs.where("text rlike '[A-Za-z]'").count()
    texts = {r["doc_id"]: r["text"] for r in told.collect()}
    firsts = [i for i, _, _, kept in brute(texts.items(), 80) if kept]
    bad = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    kept = [i for i in firsts if i not in bad]
    base = [pii.base_spans(texts[i]) for i in kept]
    more = pii.more_spans([texts[i] for i in kept], base, pii.train())
    tool, want = Tokenizer.from_file(vocabulary), []
    for i, b, m in zip(kept, base, more, strict=True):
        ids = tool.encode(pii.masked(texts[i], b + m), add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(tuple(r) for r in got) == want


def test_odd_rows_pass_all_stages(spark, odd_docs, tmp_path):
    docs, folder = odd_docs.withColumn("lang", odd_docs["lang_pred"]), "/root/testdata/sf0.001"
    assert {(r["lang_pred"], r["score"]) for r in corpus_pipeline.identify_language(spark, docs, folder).collect()} == {("en", 1.0)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage(spark, docs.limit(0), folder).count() == 0
    left = {r["doc_id"] for r in docs.collect()}
    assert {4, 6} <= left and left <= {4, 6, 7, None}
