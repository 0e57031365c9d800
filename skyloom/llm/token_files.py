"""Token ids as Parquet list columns, in document order, for selective reads.

Each file holds the documents of one range of ids, ascending: ``doc_id``, ``part`` (the range), ``start_in_part``,
``n_tokens`` and ``ids array<int>``. Ids are dictionary-coded while a row group's dictionary fits, then delta-coded
(data pages of version 2); row groups and pages have set sizes, and the page indexes that Spark's writer leaves let a
reader of some documents, or of the metadata alone, skip all other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, sliced
from .tokens import encoder

STORED = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text) dealt to ranges of doc_id and sorted inside; null ids come first, equal ids by text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartitionByRange(parts or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")


def lists(ids: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).view(np.int32), kind))


def encoded(docs: DataFrame, vocabulary: str, end_id: int, parts: int | None = None) -> DataFrame:
    """One row a document (repeated ids included; a null text is an empty one): its ids with end_id appended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        for b in sliced(batches):
            ids = [np.concatenate([x, end]) for x in encoder(vocabulary).encode(b.column(1))]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes), lists(ids, pa.int32())], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    return in_order(docs, parts).mapInArrow(run, STORED)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, row_group_mb: int = 32, page_kb: int = 256, page_rows: int = 500, parts: int | None = None) -> None:
    """Writes the files. A task that is run again writes the same file anew, and only committed files show up."""
    (
        encoded(docs, vocabulary, end_id, parts)
        .write.option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 1)
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before; only columns in use are read.

    Totals of the parts (a row for each file) are summed up and sent to all; nothing of the documents is.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def with_crc(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that ``read`` gave: unsigned crc32 of the ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            ends = np.cumsum([0, *ids.value_lengths().to_pylist()]) * 4
            crcs = [zlib.crc32(raw[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
