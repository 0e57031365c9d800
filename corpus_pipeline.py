"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it returned, written as Parquet and read again.
All but the last return the columns of documents. SQL can't express the trained language model, the similarity join or
the tokenizer, so the stages are tested against brute-force versions instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.langid import accepted, learned
from skyloom.llm.line_dedup import dedup_lines
from skyloom.llm.mixing import mix_attainable, with_topics
from skyloom.llm.near_dedup import near_duplicates
from skyloom.llm.packing import pack
from skyloom.llm.shared import quoted, read_documents, table

#: Of all tokens, the part that the mixture takes.
SHARE = 0.8

#: Pieces that packing's workers remember: few, for by then the executors hold what four stages have left.
REMEMBERED = 150_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language of their own go; lang becomes the predicted one.

    The model learns from these documents' own labels, never from held-out ones. Without any label all would be
    undetermined, so then every document stays as it is.
    """
    model = learned(docs)
    return accepted(docs, model) if model.languages else docs


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; n_chars is counted anew. Documents of which nothing is left go."""
    cleaned = dedup_lines(docs)
    left = cleaned.where((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*map(quoted, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays, with all its rows; rows without an id stay."""
    gone = table(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that their tokens come close to tempered weights of sources, languages and topics, as far as
    there are tokens; documents without a topic follow the other two."""
    rows = with_topics(docs, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    gone = table(mix_attainable(rows, SHARE).where(~F.coalesce("kept", F.lit(True))).select("doc_id").distinct(), "not-sampled")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*map(quoted, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
