"""op3: the quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import learned, measured, scored
from .shared import read_documents


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = measured(read_documents(spark, sf_dir).select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(stats, learned(stats, labels))
