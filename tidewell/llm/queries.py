"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, lm, near_dedup, packing, pii, quality, urls, warc
from .common import table


def vocabulary_file() -> str:
    """The byte-level BPE file of the public tokenizers on this machine; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(), end_id=50256)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    network = language.learn(docs.where(~held).select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "text", held.alias("held_out")), network).drop("text")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the toxic labels of the documents that carry the page's number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_near_dedup": op1_near_dedup, "op2_warc": op2_warc, "op3_pii": op3_pii, "op4_lm_scoring": op4_lm_scoring, "op5_packing": op5_packing, "op6_decontamination": op6_decontamination, "op7_quality": op7_quality, "op8_language": op8_language, "op9_urls": op9_urls, "op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": near_dedup.SQL, "op7_quality": quality.SQL, "op9_urls": urls.SQL}
