"""Ranked lexical search by inverted treaps.

For each term the documents that hold it form a treap: a search tree by document, a heap by impact, which is the whole
score that the term gives the document. All treaps of a query are walked at once. A state is an interval of documents
with, for each term, the node of greatest impact inside it; the sum of these bounds the score of every document there.
States are opened best bound first and split at the document of their strongest node; a state whose bound can't enter
the best k is dropped with all that lies below it, and a short one is summed up document by document.

Spark scans the texts once for a block of queries and writes what they need of each document (a forward table), counts
the corpus statistics from it, then every task builds the treaps of its share of documents, a bounded number of postings
at a time, and carries its best k from one share to the next. Each task returns at most k rows for each query.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import sliced, table

#: What parts terms: ASCII but digits and letters. Fixed value, of the definition of a term.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: UTF-8 bytes to terms parted by blanks: bytes of other characters than ASCII are all from 0x80 on.
TERMS = bytes(ord(chr(i).lower()) if i < 0x80 and i in _INSIDE else i if i in _INSIDE else 0x20 for i in range(256))
#: Intervals of at most so many documents are summed up instead of split.
LEAF = 1024
FORWARD = "doc_id long, n long, terms binary, tfs binary"


def terms_of(text: Column) -> Column:
    """array<string>: the terms of a text with repeats; null for a null text."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda t: t != "")


def items_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once. Rows of one item_id are one query."""
    return items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()


def forward(docs: DataFrame, terms: list[str]) -> DataFrame:
    """A row for each document with a term: its number of terms, and which of the given terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): i for i, t in enumerate(terms)}
        for b in sliced(batches, 500):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.encode().translate(TERMS).split(b" ") if text else []
                tf = Counter(words)
                n = len(words) - tf.pop(b"", 0)
                if n:
                    held = sorted((number[w], c) for w, c in tf.items() if w in number)
                    pairs = np.array(held, np.int32).reshape(-1, 2)
                    rows.append((doc_id, n, pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, FORWARD)


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term) of a forward table; a row for each term is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 2, np.int64)
        for b in batches:
            df[-2] += b.num_rows
            df[-1] += b.column(0).to_numpy().sum() if b.num_rows else 0
            held = b"".join(b.column(1).to_pylist())
            df += np.bincount(np.frombuffer(held, np.int32), minlength=n_terms + 2)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    df = np.zeros(n_terms + 2, np.int64)
    for term, n in rows.select("n", "terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return int(df[-2]), int(df[-1]), df[:-2]


class Treaps:
    """The treaps of all terms over some documents, in ascending order of id. Node 0 stands for none.

    A node is the place of its posting; postings are sorted by term and document, so a term's postings in an interval of
    documents are a slice as well.
    """

    def __init__(self, places: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int):
        order = np.lexsort((places, terms))
        self.n_docs, zero = n_docs, np.zeros(1, np.int64)
        self.place = np.concatenate([zero, places[order]])
        self.impact = np.concatenate([zero, impacts[order]])
        self.key = terms[order] * n_docs + places[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.left, self.right, self.root = self._grown(starts + 1, np.append(starts, len(order))[1:] + 1)

    def _grown(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        impact = self.impact.tolist()
        left, right, roots = [0] * len(impact), [0] * len(impact), []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            path: list[int] = []  # from the root along right children
            for i in range(a, b):
                x, below = impact[i], 0
                while path and impact[path[-1]] < x:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            roots.append(path[0])
        return np.array(left), np.array(right), np.array(roots, np.int64)

    def roots(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the given ascending terms those that occur here, and their treaps' roots."""
        at = np.searchsorted(self.terms, terms)
        here = np.flatnonzero(at < len(self.terms))
        here = here[self.terms[at[here]] == terms[here]]
        return terms[here], self.root[at[here]]

    def within(self, nodes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Of each subtree the node of greatest impact among documents in [lo, hi), by descent."""
        while True:
            place = self.place[nodes]
            before, behind = (place < lo) & (nodes > 0), (place >= hi) & (nodes > 0)
            if not (before.any() or behind.any()):
                return nodes[nodes > 0]
            nodes = np.where(before, self.right[nodes], np.where(behind, self.left[nodes], nodes))

    def scores(self, terms: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The scores of the documents in [lo, hi), exactly: sums stay far below 2^53."""
        base = terms * self.n_docs
        first, last = np.searchsorted(self.key, base + lo), np.searchsorted(self.key, base + hi)
        if hi == lo + 1:
            return np.array([self.impact[first[last > first] + 1].sum()])
        sizes = last - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()) + 1
        return np.bincount(self.place[at] - lo, self.impact[at], hi - lo).astype(np.int64)


class Best:
    """The k best (score, id) so far; the smaller id wins among equal scores, and null ids come last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def admits(self, bound: int, least_id: int) -> bool:
        if bound <= 0 or len(self.scores) < self.k:
            return bound > 0
        return bound > self.scores[-1] or (bound == self.scores[-1] and least_id < self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores > 0 if len(self.scores) < self.k else scores >= self.scores[-1]
        if fit.any():
            scores, ids = np.append(self.scores, scores[fit]), np.append(self.ids, ids[fit])
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]


def walk(treaps: Treaps, ids: np.ndarray, query: np.ndarray, best: Best) -> int:
    """Adds to best what these documents have for a query (ascending terms); returns how many states were opened."""
    terms, nodes = treaps.roots(query)
    opened = 0
    heap = [(-int(treaps.impact[nodes].sum()), 0, treaps.n_docs, nodes)] if len(nodes) else []
    while heap:
        bound, lo, hi, nodes = heapq.heappop(heap)
        if not best.admits(-bound, ids[lo]):
            if len(best.scores) == best.k and -bound < best.scores[-1]:
                break  # so are all that are left
            continue
        opened += 1
        if hi - lo <= LEAF:
            best.add(treaps.scores(terms, lo, hi), ids[lo:hi])
            continue
        at = int(treaps.place[nodes[np.argmax(treaps.impact[nodes])]])
        best.add(treaps.scores(terms, at, at + 1), ids[at : at + 1])
        for a, b in ((lo, at), (at + 1, hi)):
            if a < b and len(part := treaps.within(nodes, a, b)):
                bound = int(treaps.impact[part].sum())
                if best.admits(bound, ids[a]):
                    heapq.heappush(heap, (-bound, a, b, part))
    return opened


NO_ID = np.iinfo(np.int64).max


def _best_of(rows: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int, postings: int) -> DataFrame:
    """(query int, doc_id, score): the best k of each task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            ids, lengths, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            of = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + (50 * lengths * n) // total
            impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[of]))
            treaps, ids = Treaps(place[of], terms, impacts, len(ids)), ids[order]
            for query, b in zip(queries, best, strict=True):
                walk(treaps, ids, query, b)

        for batch in batches:
            if batch.num_rows:
                terms, tfs = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int32).astype(np.int64) for i in (2, 3))
                sizes = np.array([len(x) // 4 for x in batch.column(2).to_pylist()], np.int64)
                ids = batch.column(0).fill_null(NO_ID).to_numpy()
                held.append((ids, batch.column(1).to_numpy(), sizes, terms, tfs))
                if sum(len(x[3]) for x in held) >= postings:
                    search()
        if held:
            search()
        out = [(q, i, s) for q, b in enumerate(best) for s, i in zip(b.scores.tolist(), b.ids.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        ids = [None if i == NO_ID else i for i in cols[1]]
        arrays = [pa.array(cols[0], pa.int32()), pa.array(ids, pa.int64()), pa.array(cols[2], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(spread: DataFrame, most: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Blocks of queries with at most about so many terms together (item_id, its terms)."""
    sized = table(spread.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "queries")
    total = sized.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts = -(-total // most)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, parts)))
    for p in range(parts):
        rows = sized.where(part == p).orderBy("item_id").collect()
        if rows:
            yield [(r["item_id"], r["terms"]) for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 200_000, postings: int = 2_000_000) -> DataFrame:
    """The k best documents of each item: (item_id, rank, doc_id, score), rank from 1, equal scores by ascending doc_id.

    docs are (doc_id, text), items (item_id, text); other columns are neither read nor returned. Every document with a
    term counts in the statistics and is searched, each row as a document of its own: rows of a repeated id may all
    rank, a null id ranks behind equal scores. Null and empty texts have no term and never rank; items without a
    term, or whose terms no document holds, get no row, and so does an empty table of either. Rows of one item_id are
    one query with the terms of all.

    The items are a stated set of queries: they are taken in blocks of about ``block`` terms, each held by the driver and sent
    to the tasks; for each block the texts are scanned once. ``postings`` bounds what a task holds of the index.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    found = None
    for queries in _blocks(items_terms(items), block):
        vocabulary = sorted({t for _, terms in queries for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        rows = table(forward(docs, vocabulary), "forward")
        n, total, df = statistics(rows, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        coded = [np.array(sorted(number[t] for t in terms), np.int64) for _, terms in queries]
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(queries)], f"query int, item_id {kind.simpleString()}")
        best = _best_of(rows, coded, weights, n, total, k, postings)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row for each query of the block
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return found
