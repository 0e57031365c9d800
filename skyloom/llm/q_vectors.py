"""op7: near-duplicate vectors of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .vectors import near_vectors


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
