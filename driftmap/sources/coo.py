"""Readers and writers: coordinate CSV, distance tables, Parquet array columns, embeddings and loss logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """Entries (i, c, v) of a CSV of row, column, value; a malformed line fails the read."""
    return spark.read.schema("i LONG, c INT, v DOUBLE").option("mode", "FAILFAST").csv(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """Neighbour edges (i, j, d) of a CSV, taken as they are: no cut at k, no self-edge filter."""
    return spark.read.schema("i LONG, j LONG, d DOUBLE").option("mode", "FAILFAST").csv(path)


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors (i, x) of a Parquet table with an array column."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("x"))


def coo_to_vectors(entries: DataFrame, dimension: int) -> DataFrame:
    """Dense vectors (i, x) of entries (i, c, v): missing cells are 0, repeated cells are summed, rows without entries don't exist."""
    cells = entries.groupBy("i", "c").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
    return rows.select("i", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("x"))


def vectors_to_coo(vectors: DataFrame) -> DataFrame:
    return vectors.select("i", F.posexplode("x").alias("c", "v"))


def write_embedding(embedding: DataFrame, path: str) -> None:
    """id,y0,y1 lines, replacing what is there."""
    embedding.select("i", "y0", "y1").write.mode("overwrite").csv(path)


def loss_text(loss: dict[int, float]) -> str:
    return "{" + ", ".join(f"{k}={v}" for k, v in sorted(loss.items())) + "}"
