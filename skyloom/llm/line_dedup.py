"""Exact line deduplication across documents, as compressed keep bitmaps.

A line's key is the line without ASCII blanks at its ends and with A-Z lower-cased. Keys of at least ``least``
characters that at least two documents hold keep their lines only in the document of least id. Hashes of keys (128
bits), not texts, are range-partitioned and streamed; what comes back is a bitmap for each document that loses lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .firsts import ROW, repeats
from .shared import BLANKS, beside, quoted, sliced, table


def line_keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """Occurrences (ROW) of keys of at least ``least`` characters. Rows without an id hold none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw, doc, at, size = bytearray(), [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, line in enumerate(text.split("\n")):
                    line = line.strip(BLANKS)
                    if len(line) >= least:
                        raw += xxhash.xxh3_128_digest(line.encode().lower())
                        doc.append(key)
                        at.append(i)
                        size.append(len(line))
            h = np.frombuffer(bytes(raw), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32())], ["h1", "h2", "doc_id", "pos", "size"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROW)


def pack_bits(dropped: list[int], n: int) -> bytes:
    """zlib-compressed bits of n lines, 1 for kept ones."""
    keep = np.ones(n, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = 10, parts: int | None = None) -> DataFrame:
    """(doc_id, n_bits, bitmap) for documents that lose a line; bits after n_bits, the last dropped line, are 1."""
    gone = repeats(table(line_keys(docs, least), "line-keys"), whole_doc=True, parts=parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost = b.column(1).to_pylist()
            sizes = [max(x) + 1 for x in lost]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(map(pack_bits, lost, sizes), pa.binary())], ["doc_id", "n_bits", "bitmap"])

    return gone.groupBy("doc_id").agg(F.collect_list("pos").alias("lost")).mapInArrow(run, "doc_id long, n_bits int, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text holding its kept lines, and columns n_lines, n_dropped; a document that loses all lines has an empty text.

    A null text stays null and counts as one empty line. Other columns stay, whatever their names (a column of docs
    named n_lines or n_dropped is replaced). Rows with equal ids lose lines alike, for they are one document; rows
    without an id lose nothing.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    at = own.index("text")
    both = beside(docs, own, bitmaps.select("doc_id", "n_bits", "bitmap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, lines, dropped = [], [], []
            for text, n, bits in zip(*(b.column(i).to_pylist() for i in (at, len(own), len(own) + 1)), strict=True):
                split = (text or "").split("\n")
                gone = 0
                if bits is not None and text is not None:
                    keep = np.ones(len(split), bool)
                    m = min(n, len(split))
                    keep[:m] = unpack_bits(bits, n)[:m]
                    gone = int((~keep).sum())
                    text = "\n".join([x for x, k in zip(split, keep.tolist(), strict=True) if k])
                texts.append(text)
                lines.append(len(split))
                dropped.append(gone)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    kinds = ", ".join(f"{quoted(c)} {'string' if c == 'text' else t}" for c, t in docs.dtypes if c in own)
    return both.mapInArrow(run, f"{kinds}, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, least: int = 10, parts: int | None = None) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, least, parts))
