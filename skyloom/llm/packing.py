"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a range of ids form one stream. Windows may be cut after a document, after a sentence or, where a
sentence is long, every ``stride`` ids inside it. A cutting costs the padding of each window plus a penalty for each cut
that truncates a document; the cheapest cutting is found left to right, with the best start of a padded window at the
head of a monotone queue. A window of exactly a power of two isn't padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sliced, table
from .token_files import in_order
from .tokens import REMEMBERED, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window_in_part long, offset long"


def cut(ends: np.ndarray, penalty: np.ndarray, size: int, each: float = 12.0) -> list[int]:
    """The chosen ends of windows: a subset of ends (ascending, no gap above size, the last among them).

    Minimises the sum over windows of padding (size - length, or 0 if the length is a power of two) and of the penalty
    of the end and ``each``. Ties take the earliest start, that is the longest window.
    """
    n = len(ends)
    at = np.concatenate([[0], ends]).astype(np.int64)
    exact: list[list[int] | None] = [None] * n
    place = np.full(int(at[-1]) + 1, -1, np.int32)
    place[at] = np.arange(n + 1)
    power = 1
    while power <= size:
        ahead = int(np.searchsorted(at, power))  # earlier ends have no start so far behind them
        start = place[at[ahead:] - power]
        hit = np.flatnonzero(start >= 0)
        for j, i in zip((hit + ahead - 1).tolist(), start[hit].tolist(), strict=True):
            exact[j] = [*(exact[j] or []), i]
        power *= 2
    best, back = [0.0], [0]
    # A padded window from i to j costs best[i] + size - (pos[j] - pos[i]) + pen[j]: the queue holds i by best[i] + pos[i].
    keys, starts, places, head = [0.0], [0], [0], 0
    for j, (p, pen, closed) in enumerate(zip(at[1:].tolist(), (penalty + each).tolist(), exact, strict=True), 1):
        low = p - size
        while places[head] < low:
            head += 1
        key, i = keys[head] + size, starts[head]
        if closed:
            cost = key - p
            for x in closed:
                if best[x] < cost or (best[x] == cost and x < i):
                    cost, i = best[x], x
            key = cost + p
        key += pen
        best.append(key - p)
        back.append(i)
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            starts.pop()
            places.pop()
        keys.append(key)
        starts.append(j)
        places.append(p)
    pos = at.tolist()
    out, j = [], n
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, stride: int, at_sentence: float, inside: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and what ending there costs."""
    stop = ends_sentence[ids]
    stop[doc_ends - 1] = True
    ends = np.flatnonzero(stop) + 1
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > stride)
    extra = np.zeros(0, np.int64)
    if len(wide):
        extra = np.concatenate([np.arange(a + stride, a + g, stride) for a, g in zip((ends - gaps)[wide].tolist(), gaps[wide].tolist(), strict=True)])
        ends = np.sort(np.concatenate([ends, extra]))
    cost = np.full(len(ends), at_sentence)
    cost[np.searchsorted(ends, extra)] = inside
    cost[np.searchsorted(ends, doc_ends)] = 0.0
    return ends, cost


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 1024, at_sentence: float = 2.0, inside: float = 8.0, stride: int = 64, block: int = 1 << 20, parts: int | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is packed, equal ids as documents of their own; a null text is an empty one and has its end id
    only. Columns other than doc_id and text aren't read. Streams are cut in blocks of whole documents of about
    ``block`` ids, so that a task holds one block; a block ends with a window. The pieces are written to a scratch table
    once, because the number of windows before each range is needed for sequence_id. A worker keeps ``remembered`` pieces twice
    at most: fewer take less memory and more time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary, remembered)
        stops = enc.ends_sentence()
        end = np.array([end_id], np.uint32)

        def close(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            nonlocal done
            ids = np.concatenate([x for _, x in held])
            doc_ends = np.cumsum([len(x) for _, x in held])
            wins = np.array(cut(*candidates(ids, doc_ends, stops, stride, at_sentence, inside), size), np.int64)
            bounds = np.union1d(wins, doc_ends)
            starts = np.concatenate([[0], bounds[:-1]])
            doc = np.searchsorted(doc_ends, starts, "right")
            win = np.searchsorted(wins, starts, "right")
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip((starts * 4).tolist(), (bounds * 4).tolist(), strict=True)]
            sizes = np.diff(doc_ends, prepend=0)
            names = pa.array([k for k, _ in held], pa.int64()).take(pa.array(doc))
            out = [names, starts - (doc_ends - sizes)[doc], bounds - starts, np.array(crcs, np.int64), sizes[doc], np.full(len(doc), part, np.int32), done + win, starts - np.concatenate([[0], wins[:-1]])[win]]
            done += len(wins)
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window_in_part", "offset"])

        held, total = [], 0
        for b in sliced(batches):
            for key, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                held.append((key, np.concatenate([ids, end])))
                total += len(ids) + 1
                if total >= block:
                    yield close(held)
                    held, total = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield close(held)

    pieces = table(in_order(docs, parts).mapInArrow(run, PIECES), "pieces")
    totals = pieces.groupBy("part").agg((F.max("window_in_part") + 1).alias("windows"))
    before = totals.select("part", (F.sum("windows").over(Window.orderBy("part")) - F.col("windows")).alias("before"))
    return pieces.join(F.broadcast(before), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("window_in_part")).alias("sequence_id"), "offset")
