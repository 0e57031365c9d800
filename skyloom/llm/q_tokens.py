"""op2, op6 and op11: token files, packed sequences and token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .packing import pack
from .shared import read_documents, scratch
from .token_counts import count_tokens
from .token_files import read, with_crc, write


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write(read_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return with_crc(read(spark, path))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
