"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, linededup, media, mixing, neardup, oracles, quality, records, substring, urls, warc


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    df = quality.judged(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", F.round("host_rate", 6).alias("host_rate"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = linededup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records.stored(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"), end_id=1)
    return df.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return df.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), *mixing.ADDED)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES).withColumn("purity", F.round("purity", 6))


def op3_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = warc.packed(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = media.document_media(table(spark, sf_dir, "documents").select("doc_id", "text")).where("kind = 'image'")
    return df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = neardup.linked(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)
    return df.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_warc_packages, op4_line_dedup, op5_bpe, op6_token_records, op7_mixing, op8_media_columns, op9_substring_dedup, op10_near_dedup)}
ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_url_filter": oracles.url_sql(RULES, urls.UNWANTED, urls.FAN),
    "op3_warc_packages": oracles.ARCHIVES,
    "op4_line_dedup": oracles.LINES,
    "op9_substring_dedup": oracles.REPEATS,
    "op10_near_dedup": oracles.NEAR,
}
