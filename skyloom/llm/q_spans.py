"""op4: documents without repeated runs of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import read_documents
from .span_dedup import dedup_spans


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(read_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "removed", "text")
