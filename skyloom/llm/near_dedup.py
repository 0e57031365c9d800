"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of five-word shingles. Equal sets become one class with its least id. Each of ``trees`` independent
trees puts a class into the node of one minwise token; two sets of similarity 0.75 share such a node with probability
0.75 a tree, so twelve trees miss one pair in sixteen million. Only components are asked for, so pairs that a confirmed
chain already joins needn't be found:

- First the nodes of the first ``early`` trees are dealt to chunks of at most about ``small`` members, each tree anew, and
  each chunk offers the greatest spanning forest of its candidates by estimated similarity. What of it is confirmed makes
  the first components; chunks of several trees overlap at random, so that large groups of copies become few components.
- Then all trees count. A node of one component is done. A node in which members of different components make up at
  most ``small``^2 / 2 pairs is a leaf: these pairs are compared exhaustively. Any other node branches: its members pick
  further minwise tokens, ``branches`` of them, and so go into children, which are treated alike. Documents that merely
  share a common shingle part quickly. Where the children would hold more than half as many pairs, as with members that
  are all half alike, branching doesn't pay, and the node is a leaf all the same; large leaves are compared by blocks.
- A leaf offers a greatest spanning forest of its components. Where a refuted pair hides others, the leaf is compared
  anew by the least ``LOW`` shingles of its members, which are whole sets for most texts, and offers what holds.

Sketches of 256 bins tell candidates (of pairs at 0.75, fewer than one in ten million isn't one), and full sets of whole
texts confirm every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, let_go, sliced, table, union_all
from .shingles import BINS, COORDINATES, agreement, bits, linked, may_reach, shingles, signatures, sketches

#: Tables of at most so many ids (8 MB of longs) are sent to every executor; larger ones are joined by shuffles.
SENDABLE = 1_000_000
#: Of a set, so many least hashes are compared where sketches leave doubt; smaller sets are compared whole.
LOW = 1024
#: A leaf of more members than so many is dealt to blocks.
BLOCK = 4096


def small_enough(ids: DataFrame, most: int = SENDABLE) -> DataFrame:
    """A written table of ids alone, marked for broadcast if it has at most so many rows."""
    if [t for _, t in ids.dtypes] != ["bigint"]:
        raise ValueError("only a table of ids has a known width")
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, sig, sketch) of every row: set size, 128-bit fingerprint, minwise values and sketch; null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in sliced(batches, 500):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full])
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[i]) for i in full), np.int64).reshape(-1, 2)
            row = np.full(len(sets), -1, np.int64)
            row[full] = np.arange(len(full))
            at = pa.array(row, mask=row < 0)
            sketch = [x.tobytes() for x in sketches([sets[i] for i in full])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * COORDINATES), pa.array(sig.ravel().view(np.int64)))
            cols = [pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists, pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(c.take(at) for c in cols)], ["doc_id", "n", "f1", "f2", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig array<long>, sketch binary")


def _unpack(sketch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, BINS)


def _fits(n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])


def _forest(sk: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], bool]:
    """Edges of a greatest spanning forest of components by estimated similarity, and whether there are other candidates."""
    full, names, comp = bits(sk), *np.unique(comp, return_inverse=True)
    order = np.argsort(np.bincount(comp), kind="stable")  # members of the largest component need no turn of their own
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    turn = rank[comp]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(turn < len(names) - 1).tolist():
        others = np.flatnonzero(turn > turn[i])
        others = others[_fits(n, i, others, percent)]
        same, either = agreement(sk, full, i, others)
        near = may_reach(same, either, percent / 100)
        if near.any():
            others = others[near]
            found.append((same[near] / either[near], np.full(len(others), i), others))
    if not found:
        return [], False
    near, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    root, out = list(range(len(names))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in np.argsort(-near, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        x, y = top(int(comp[i])), top(int(comp[j]))
        if x != y:
            root[x] = y
            out.append((i, j))
            if len(out) == len(names) - 1:
                break
    return out, len(near) > len(out)


class Lows:
    """The least LOW hashes of each member's set, for counting what pairs have in common, never too little.

    Hashes are looked up in a table of 2**20 marks, where now and then one passes for another; members are compared a few
    hundred at a time. So memory stays small whatever the size of the node.
    """

    MARKS, TOGETHER = 1 << 20, 256

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.lists = [np.frombuffer(x, np.uint32) for x in raw]
        self.sizes = np.array([len(x) for x in self.lists])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(self.lists) & np.uint32(self.MARKS - 1)
        self.mark = np.zeros(self.MARKS, bool)
        self.last = np.array([int(x[-1]) if m > LOW else 1 << 32 for x, m in zip(self.lists, n.tolist(), strict=True)])

    def hold(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others that may be linked to i; but for chance matches of hashes they are if both sets are whole."""
        own = self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = True
        kept = [self._some(i, others[k : k + self.TOGETHER], percent) for k in range(0, len(others), self.TOGETHER)]
        self.mark[own] = False
        return np.concatenate(kept) if kept else others

    def _some(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        cells = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - sizes), sizes)
        common = np.add.reduceat(self.mark[self.flat[cells]], ends - sizes, dtype=np.int64) + 2
        top = np.minimum(self.last[i], self.last[others])
        mine = np.searchsorted(self.lists[i], top, "right")
        theirs = np.array([np.searchsorted(self.lists[j], t, "right") if t < self.last[j] else k for j, t, k in zip(others.tolist(), top.tolist(), sizes.tolist(), strict=True)])
        union = mine + theirs - common
        return others[np.where(top >= 1 << 32, 100 * common >= percent * union, may_reach(common, union, percent / 100))]


def _joining(sk: np.ndarray, n: np.ndarray, comp: np.ndarray, low: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs of members that hold by sketches and by least hashes, enough to join all components that can be.

    A pair of whole sets that holds joins its components, so that no other pair between them is asked for; where sets
    are longer than LOW all pairs that may hold are returned.
    """
    full, comp, out, lows = bits(sk), comp.copy(), [], Lows(low, n)
    for i in range(len(n)):
        others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        others = others[_fits(n, i, others, percent)]
        others = others[may_reach(*agreement(sk, full, i, others), percent / 100)]
        for j in lows.hold(i, others, percent).tolist():
            if comp[i] == comp[j]:
                continue
            if n[i] <= LOW and n[j] <= LOW:
                common = len(np.intersect1d(lows.lists[i], lows.lists[j], assume_unique=True))
                if 100 * common < percent * (len(lows.lists[i]) + len(lows.lists[j]) - common):
                    continue
                comp[comp == comp[j]] = comp[i]
            out.append((i, j))
    return out


def lows_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, low): the highest 32 bits of the least LOW hashes of the sets of these ids, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique((shingles(t)[:LOW] >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "low"])

    return texts_of(docs).join(small_enough(table(ids, "low-ids")), "id", "left_semi").mapInArrow(run, "id long, low binary").dropDuplicates(["id"])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def leaf_pairs(rows: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """Candidate pairs (node, a, b, more) of leaves: a forest of components, more telling of other candidates in the leaf.
    With exact, by least hashes, pairs that join all components that can be.

    rows: (node, id, comp, n, sketch), and for exact ones also low.
    """
    names = ["node", "id", "comp", "n", "sketch", *(["low"] if exact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: pa.Table | None = None
        for b in _then_none(batches):
            new = [] if b is None else [pa.Table.from_batches([b])]
            now = pa.concat_tables(([] if held is None else [held]) + new) if held is not None or new else None
            if now is None or not now.num_rows:
                continue
            node = now["node"].to_numpy()
            cuts = np.flatnonzero(np.diff(node)) + 1
            last = len(node) if b is None else (int(cuts[-1]) if len(cuts) else 0)
            held = None if b is None else now.slice(last)
            starts = np.concatenate([[0], cuts[cuts < last]]).astype(np.int64)
            ends = np.append(starts[1:], last)
            starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
            if not last or not len(starts):
                continue
            ids, comp, n = now["id"].to_numpy(), now["comp"].to_numpy(), now["n"].to_numpy()
            out: list[tuple[int, int, bool]] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                sk = _unpack(now["sketch"].slice(s, e - s))
                if exact:
                    got, more = _joining(sk, n[s:e], comp[s:e], now["low"].slice(s, e - s).to_pylist(), percent), False
                else:
                    got, more = _forest(sk, n[s:e], comp[s:e], percent)
                out += [(s + i, s + j, more) for i, j in got]
            if out:
                i, j, more = (np.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(more)], ["node", "a", "b", "more"])

    dealt = rows.select(*names).repartition("node").sortWithinPartitions("node", "id")
    return dealt.mapInArrow(run, "node long, a long, b long, more boolean").where("a <> b")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def compared(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of written pairs (a, b): whether their full sets are linked. Of repeated ids, any texts count."""
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    texts = texts_of(docs).join(small_enough(ids), "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, held = None, None
        for b in sliced(batches, 500):
            yes = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held is None or x != text:
                    text, held = x, shingles(x)
                yes.append(linked(held, shingles(y), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(yes, pa.bool_())], ["a", "b", "linked"])

    found = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _child(k: int) -> Column:
    """The k-th child of node parent: all members pick the same further coordinate."""
    c = F.pmod(F.xxhash64("parent", F.lit(k)), F.lit(COORDINATES)).cast("int")
    return F.xxhash64("parent", F.lit(k), F.element_at("sig", c + 1))


def first_links(members: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, small: int, early: int) -> DataFrame:
    """(a, b, linked) of forests of chunks of the first trees. members: (t, node, id, size)."""
    chunk = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("size") / small))
    rows = members.where(F.col("t") < early).select(F.xxhash64("node", chunk).alias("node"), "id", F.col("id").alias("comp"))
    pairs = leaf_pairs(rows.join(reps.select("id", "n", "sketch"), "id"), percent).select("a", "b").distinct()
    return table(compared(table(pairs, "first-pairs"), docs, percent), "first-tested")


def _sizes(nodes: DataFrame, *more: str) -> DataFrame:
    """Of nodes with several components: size, the largest component, and the pairs of members that lie in different ones."""
    each = nodes.groupBy("node", *more, "comp").agg(F.count("*").alias("c"))
    pairs = (F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2
    return each.groupBy("node", *more).agg(F.sum("c").alias("size"), pairs.alias("pairs"), F.max(F.struct("c", "comp"))["comp"].alias("largest")).where("pairs > 0")


def leaves_of(nodes: DataFrame, reps: DataFrame, small: int, branches: int, depth: int) -> DataFrame:
    """(node, id, comp) of leaves with more than one component; node names a leaf, or a block of one. nodes: (node, id, comp)."""
    few, found = small * small // 2, []
    is_leaf = F.col("pairs") <= few
    sizes = table(_sizes(nodes), "node-sizes")
    for level in range(depth + 1):
        members = nodes.join(sizes, "node")
        if level == depth or sizes.where(~is_leaf).isEmpty():
            found.append(members)
            break
        found.append(members.where(is_leaf))
        large = members.where(~is_leaf)
        children = large.select(F.col("node").alias("parent"), "id", "comp").join(reps.select("id", "sig"), "id")
        children = table(children.select("parent", "id", "comp", F.explode(F.array([_child(k) for k in range(branches)])).alias("node")), "children")
        below = table(_sizes(children, "parent"), "child-sizes")
        sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("pairs").alias("below"))
        pays = table(sizes.where(~is_leaf).join(sums, "node", "left").select("node", (F.coalesce("below", F.lit(0.0)) * 2 < F.col("pairs")).alias("pays")), "branching")
        found.append(large.join(pays.where("not pays").select("node"), "node", "left_semi"))
        branched = pays.where("pays").select(F.col("node").alias("parent"))
        nodes = children.join(branched, "parent", "left_semi").select("node", "id", "comp")
        sizes = below.join(branched, "parent", "left_semi").drop("parent")
    blocks = F.ceil(F.col("size") / F.when(is_leaf, BLOCK).otherwise(BLOCK // 2)).cast("int")
    own, every = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    both = F.transform(every, lambda y: F.least(own, y) * blocks + F.greatest(own, y))
    block = F.when(~is_leaf, both).when(F.col("comp") == F.col("largest"), F.array(own)).otherwise(every)
    return union_all(found).select("node", "id", "comp", F.explode(block).alias("block")).select(F.xxhash64("node", "block").alias("node"), "id", "comp")


def joined_components(reps: DataFrame, docs: DataFrame, percent: int = 75, trees: int = 12, small: int = 512, early: int = 4, branches: int = 3, depth: int = 4) -> DataFrame:
    """(id, component) of the classes that are linked to another. reps: (id, n, sig, sketch), one a class."""
    nodes = reps.select("id", F.posexplode(F.slice("sig", 1, trees)).alias("t", "v")).select("t", F.xxhash64("t", "v").alias("node"), "id")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = table(nodes.join(sizes, "node"), "members")
    tested = first_links(members, reps, docs, percent, small, early)
    comps = table(components(tested.where("linked")), "first-components")

    leaves = table(leaves_of(_with_component(members.select("node", "id"), comps, "id", "comp"), reps, small, branches, depth), "leaves")
    known = reps.select("id", "n", "sketch")
    offered = table(leaf_pairs(leaves.join(known, "id"), percent), "offered")
    new = table(offered.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    then = table(compared(new, docs, percent), "tested")
    refuted = tested.unionByName(then).where("not linked").select("a", "b")
    doubtful = table(offered.where("more").join(refuted, ["a", "b"]).select("node").distinct(), "doubtful-leaves")
    found = then.where("linked").select("a", "b")
    if not doubtful.isEmpty():
        again = table(leaves.join(doubtful, "node", "left_semi").distinct(), "again")
        lows = lows_of(again.select("id").distinct(), docs)
        pairs = leaf_pairs(again.join(known, "id").join(lows, "id"), percent, exact=True).select("a", "b").distinct()
        pairs = table(pairs.join(refuted, ["a", "b"], "left_anti"), "pairs")
        found = found.unionByName(compared(pairs, docs, percent).where("linked").select("a", "b"))
    return components_with(comps, found)


def components_with(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, component) once edges (a, b) are added."""
    edges = table(edges, "links")
    between = _with_component(_with_component(edges, comps, "a", "comp_a"), comps, "b", "comp_b")
    joined = components(between.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    new = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti")
    known = comps.unionByName(new.withColumn("component", F.col("id")))
    return known.join(joined.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def _with_component(rows: DataFrame, comps: DataFrame, of: str, name: str) -> DataFrame:
    known = comps.select(F.col("id").alias(of), F.col("component").alias("__comp"))
    return rows.join(known, of, "left").withColumn(name, F.coalesce("__comp", of)).drop("__comp")


def near_duplicates(docs: DataFrame, percent: int = 75, trees: int = 12, small: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of docs; kept marks the least id of each component.

    Null and blank texts have empty sets and are alone. Rows without an id are alone too: their component_id is null and
    they are kept. Repeated ids are one document for links: any of their texts may be linked. Columns other than doc_id
    and text aren't read.
    """
    sets = table(sets_of(docs), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    reps = table(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "classes")
    comps = joined_components(reps, docs, percent, trees, small)
    classes = reps.select("f1", "f2", "id").join(comps, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component_id"))
    row = lambda df, c: df.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(True)).alias("kept"))
    alone = sets.where("not (n > 0 and doc_id is not null)")
    return row(full.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"]), F.col("component_id")).unionByName(row(alone, F.col("doc_id")))
