"""The corpus pipeline: quality rules, line dedup, near dedup, mixing and encoding, over whole documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
and hands the written table to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm import bpe, linededup, mixing, neardup, quality
from driftmap.llm.common import written
from driftmap.llm.queries import tokenizer


def apart(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with those columns renamed that an operator would replace, and the columns that give back docs'."""
    names = [f"__own_{c}" if c in added else c for c in docs.columns]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document rules and whose host is not rejected."""
    df, own = apart(docs, quality.ADDED)
    return quality.judged(df).where("kept").select(*own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    df, own = apart(docs, linededup.ADDED)
    df = linededup.deduped(df, min_docs=10)
    changed = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    df = df.withColumn("text", changed).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    return neardup.deduped(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and their position in the mix, in its order (weights: the square roots of the sources' counts)."""
    return mixing.mixed_order(docs, place="position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position and the document's tokens, sorted by position; the text is what decoding them gives."""
    docs = docs.orderBy("position", "doc_id")  # files are not read in the order in which they were written
    return bpe.encoded(docs.select("doc_id", "lang", "source", "position", "text"), tokenizer("byte_bpe_50k.json")).drop("text")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("BPE encoding", encode)]
#: The schedule and the tokenizer are not expressible in SQL; tests/llm/test_pipeline_rows.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        df = written(stage(spark, df, sf_dir), name.replace(" ", "-"), "snappy")
    return STAGES[-1][1](spark, df, sf_dir)
