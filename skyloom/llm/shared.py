"""What the operators of this package share: scratch tables, folds, batch settings and connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, written

T = TypeVar("T")

table = written

#: The ASCII white space of the contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows. Spark bounds a batch by its bytes (64 MB); what is made of it at once is bounded here."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def sliced_by_size(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices whose texts in a column begin within so many bytes of each other: their sum is bounded by that and one text."""
    for b in sliced(batches):
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)


def quoted(name: str) -> str:
    """A column's name as expressions and schemas need it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [df[quoted(c)] for c in names]


def beside(docs: DataFrame, own: Sequence[str], found: DataFrame) -> DataFrame:
    """The columns own of docs by position, and behind them those of found (doc_id and others) for the same id, null without one.

    Names may clash: columns of the result are named by place. Rows without an id are spread by their text, not dealt to one task.
    """
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns_of(docs, own))], F.col("doc_id").cast("long").alias("key"))
    rows = rows.withColumn("salt", F.when(F.col("key").isNull(), F.xxhash64(f"c{list(own).index('text')}")).otherwise(F.lit(0)))
    others = [c for c in found.columns if c != "doc_id"]
    right = found.select(F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("salt"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(others)])
    return rows.join(right, ["key", "salt"], "left").select(*[f"c{i}" for i in range(len(own))], *[f"f{i}" for i in range(len(others))])


_held: dict[str, object] = {}


def held_by_worker(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under this name; it keeps one such thing at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]  # type: ignore[return-value]


def let_go() -> None:
    """Frees what the worker holds for other work, and what Arrow keeps of earlier batches: memory-hungry tasks begin with this."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the documents that nothing may learn from: crc32 of the id as text leaves 2 by 4. A null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(True))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is_star_forest(e: DataFrame) -> bool:
    """Whether each u of edges (u, v) has one v only, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    roles = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return roles.where((F.col("child") > 1) | (F.col("child") + F.col("root") > 1)).isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (id, component), component being the smallest id.

    Alternates large-star and small-star steps. Minima of neighbourhoods come from partial aggregates, so that a vertex
    with very many edges is no hot task; each round is written to a scratch table. Isolated ids aren't in the result.
    """
    e = table(edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not _is_star_forest(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = table(small.where("u <> v").distinct(), name)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
