"""First occurrences in a range-partitioned, secondarily sorted stream of hashed keys.

Occurrences (h1, h2, doc_id, pos, ...) are dealt to ranges of (h1, h2, doc_id, pos) and sorted in each, so a very common
key is spread over as many ranges as its rows need. Each range is streamed once: all rows of a key after its first are
repeats. Only the key that a range begins with may have begun in an earlier one; its rows that look first, and what each
range ends with (a row for each range), settle that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, table

ROW = "h1 long, h2 long, doc_id long, pos int, size int"
_NAMES = ["h1", "h2", "doc_id", "pos", "size", "kind"]
REPEAT, UNDECIDED, TAIL = 0, 1, 2


def repeats(rows: DataFrame, whole_doc: bool, parts: int | None = None) -> DataFrame:
    """The repeats among rows (schema ROW): (doc_id, pos, size).

    A key's first row is that of least (doc_id, pos). With whole_doc, all its rows in the same doc_id are first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        leading = True
        for b in batches:
            h1, h2, doc, pos, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            n = len(h1)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if key is not None:
                new[0] = (h1[0], h2[0]) != key
            run_of = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            doc0, pos0 = doc[at], pos[at]
            if not new[0]:
                run_of += 1
                doc0, pos0 = np.append(first[0], doc0), np.append(first[1], pos0)
            first_here = doc == doc0[run_of]
            if not whole_doc:
                first_here &= pos == pos0[run_of]
            head = run_of == 0 if leading else np.zeros(n, bool)
            kind = np.full(n, -1, np.int8)
            kind[~first_here] = REPEAT
            kind[first_here & head] = UNDECIDED
            if run_of[-1] > 0:
                leading = False
            key, first = (h1[-1], h2[-1]), (doc0[run_of[-1]], pos0[run_of[-1]])
            out = np.flatnonzero(kind >= 0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (h1, h2, doc, pos, size, kind)], _NAMES)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *first, 0, TAIL), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8()), strict=True)], _NAMES)

    cols = ["h1", "h2", "doc_id", "pos"]
    dealt = rows.select(*cols, "size").repartitionByRange(parts or partitions(rows.sparkSession), *cols).sortWithinPartitions(*cols)
    found = table(dealt.mapInArrow(run, f"{ROW}, kind byte"), "repeats")
    tails = found.where(F.col("kind") == TAIL).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"))  # a row for each range at most
    here = F.struct("doc_id") if whole_doc else F.struct("doc_id", "pos")
    there = F.struct("first.doc_id") if whole_doc else F.struct("first.doc_id", "first.pos")
    settled = found.where(F.col("kind") == UNDECIDED).join(F.broadcast(tails), ["h1", "h2"]).where(there < here)
    return found.where(F.col("kind") == REPEAT).select("doc_id", "pos", "size").unionByName(settled.select("doc_id", "pos", "size"))
