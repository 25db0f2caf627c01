"""Counts and health of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: n_chunks, n_vectors (with a non-empty id) and progress, 0.0 without chunks; stale vectors can raise it above 1."""
    left = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    right = vectors.agg(F.count_if(F.coalesce(F.length("chunk_id"), F.lit(0)) > 0).alias("n_vectors"))
    progress = F.when(F.col("n_chunks") == 0, F.lit(0.0)).otherwise(F.col("n_vectors") / F.col("n_chunks"))
    return left.join(right, F.lit(True)).withColumn("progress", progress)


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n_chunks"))
