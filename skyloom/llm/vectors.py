"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is turned by random signs and Hadamard transforms, three times; its hash is the axis it then lies closest to.
``hashes`` such axes make a code, and ``tables`` codes are drawn independently. A vector stands in the bucket of its own
code and probes those of the ``probes - 1`` next best codes, the ones that lose least by trading an axis for the second,
third or fourth closest. Members of a bucket are compared with those that probe it, by cosine in double precision.

Equal vectors become one class first. Of what meets in a bucket only sums leave the task: for each vector the number
of vectors linked there and not in any earlier bucket, and a spanning forest of the links for the components. So a large
group of near copies costs comparisons but never a row for each of its pairs. Buckets of more than ``block`` members
are compared block against block in separate tasks; none is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, table

SEEN = 4  # axes of each hash that probes may use
TURNS = 3


@dataclass(frozen=True)
class Scheme:
    hashes: int
    tables: int
    probes: int = 4

    @staticmethod
    def of(rows: int, width: int) -> Scheme:
        """Enough hashes a code that an average bucket stays small however many rows there are, and enough tables for them.

        Measured at cosine 0.93 in 64 dimensions, a table of 2 hashes and 4 probes finds 0.72 of all pairs; each further
        hash costs about three tenths. Tables are added until fewer than one pair in 20,000 is missed.
        """
        axes = 2 * _power(width)
        hashes = max(2, math.ceil(math.log(max(rows, 64) / 64) / math.log(axes)))
        each = 0.71 * 0.7 ** (hashes - 2)
        return Scheme(hashes, math.ceil(math.log(5e-5) / math.log(1 - each)))


def _power(width: int) -> int:
    return 1 << max(2, (width - 1).bit_length())  # no fewer axes than probes may use


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, in place of a multiplication by a dense rotation."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(v: np.ndarray, scheme: Scheme, seed: int = 7) -> np.ndarray:
    """int64 (rows x tables x probes): the own code of each row first, then those it probes, best first."""
    n, d = v.shape
    wide = np.zeros((n, _power(d)))
    wide[:, :d] = v
    rng = np.random.default_rng(seed)
    combos = np.stack(np.meshgrid(*[np.arange(SEEN)] * min(scheme.hashes, 2), indexing="ij"), -1).reshape(-1, min(scheme.hashes, 2))
    if scheme.hashes > 2:  # trades in one or two of the hashes; more of them are never among the best few
        pairs = [(a, b, x, y) for a in range(scheme.hashes) for b in range(a + 1, scheme.hashes) for x, y in combos.tolist()]
        combos = np.zeros((len(pairs), scheme.hashes), np.int64)
        for k, (a, b, x, y) in enumerate(pairs):
            combos[k, a], combos[k, b] = x, y
        combos = np.unique(combos, axis=0)
    out = np.empty((n, scheme.tables, scheme.probes), np.int64)
    for t in range(scheme.tables):
        loss, code = np.zeros((n, len(combos))), np.zeros((n, len(combos)), np.int64)
        for k in range(scheme.hashes):
            x = wide
            for _ in range(TURNS):
                x = _hadamard(x * rng.choice([-1.0, 1.0], wide.shape[1]))
            size = np.abs(x)
            best = np.argsort(-size, axis=1, kind="stable")[:, :SEEN]
            size = np.take_along_axis(size, best, 1)
            axis = best * 2 + (np.take_along_axis(x, best, 1) < 0)
            pick = combos[:, k]
            loss += ((size[:, :1] - size) ** 2)[:, pick]
            code = code * (2 * wide.shape[1]) + axis[:, pick]
        order = np.argsort(loss, axis=1, kind="stable")[:, : scheme.probes]
        out[:, t] = np.take_along_axis(code, order, 1)
    return out


def _unit(raw: pa.Array, width: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, width)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _first_here(a: np.ndarray, b: np.ndarray, t: int, code: int) -> np.ndarray:
    """Whether (t, code) is the first bucket in which the pairs (rows of a, rows of b) meet."""
    ok = np.ones(len(a), bool)
    for s in range(t):
        ok &= ~((a[:, s, :1] == b[:, s]).any(1) | (b[:, s, :1] == a[:, s]).any(1))
    other = np.where((a[:, t, 0] == code) & (a[:, t] == b[:, t, :1]).any(1), b[:, t, 0], code)
    other = np.minimum(other, np.where((b[:, t, 0] == code) & (b[:, t] == a[:, t, :1]).any(1), a[:, t, 0], code))
    return ok & (other >= code)


def _meet(t: int, code: int, own: np.ndarray, side: np.ndarray, two: bool, v: np.ndarray, c: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the members of a bucket or of two of its blocks: links that are first met here, and a forest of all links."""
    n = len(v)
    near = (v @ v.T >= least) & (own[:, None] | own[None, :])
    if two:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    counts = np.zeros(n, np.int64)
    forest: list[tuple[int, int]] = []
    if not near.any():
        return counts, forest
    for i in range(n):
        j = np.flatnonzero(near[i, i + 1 :]) + i + 1
        if len(j):
            j = j[_first_here(np.broadcast_to(c[i], (len(j), *c[i].shape)), c[j], t, code)]
            counts[i] += size[j].sum()
            counts[j] += size[i]
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            i = todo.pop()
            hit = np.flatnonzero(near[i] & left)
            left[hit] = False
            forest += [(i, int(j)) for j in hit]
            todo += hit.tolist()
    return counts, forest


def near_vectors(rows: DataFrame, least: float = 0.93, scheme: Scheme | None = None, block: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each of rows: (vec_id, n_links, component_id, kept).

    Vectors are compared only within equal labels, by cosine in double precision against ``least``. Null, empty and zero
    vectors, those with null or non-finite components and those without a label link with nothing: n_links 0, and a
    component of their own. Vectors of different widths never link. Rows without an id are alone, have a null
    component_id and are kept; rows that repeat an id are different vectors of one name, so their links count together
    and to each other by id. Other columns aren't read.
    """
    spark = rows.sparkSession
    name, vec, lab = F.col(key).cast("long"), F.col(vector).cast("array<double>"), F.col(label).cast("string")
    fine = vec.isNotNull() & lab.isNotNull() & name.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    given = table(rows.select(name.alias("id"), lab.alias("label"), F.when(F.coalesce(fine, F.lit(False)), vec).alias("v")), "vectors")
    valid = given.where("v is not null")
    size = F.size("v")
    classes = table(valid.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("size")), "classes").withColumn("width", size).withColumn("class", F.xxhash64("label", "v"))
    total = classes.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    if not total["n"]:
        return given.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    plan = scheme or Scheme.of(total["n"], total["width"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths, lists = b.column(3).to_numpy(), b.column(2)
            for w in np.unique(widths).tolist():
                at = pa.array(np.flatnonzero(widths == w))
                v = lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
                top = np.abs(v).max(1)[:, None]  # so that squares neither vanish nor overflow
                v = v / top
                c = codes(v / np.sqrt((v * v).sum(1))[:, None], plan)
                n = len(v)
                probed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c[0].size), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(np.full(n, w, np.int32)), b.column(4).take(at), b.column(5).take(at), probed],
                    ["id", "label", "v", "width", "size", "class", "codes"],
                )

    signed = table(classes.select("id", "label", "v", "width", "size", "class").mapInArrow(sign, "id long, label string, v binary, width int, size long, class long, codes array<long>"), "codes")
    stands = signed.select("class", "id", "label", "width", F.posexplode("codes").alias("at", "code")).select(
        "class", "id", F.xxhash64("label", "width", F.floor(F.col("at") / plan.probes), "code").alias("bucket"), F.floor(F.col("at") / plan.probes).cast("int").alias("t"), "code", (F.col("at") % plan.probes == 0).alias("own")
    )
    sizes = table(stands.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "buckets")
    mine = F.pmod(F.xxhash64("class", F.lit(3)), F.col("blocks")).cast("int")
    # Block pairs (i, j) with i <= j: a member stands in its own row and its own column of them.
    met = stands.join(sizes, "bucket").select("class", "id", "bucket", "t", "code", "own", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("class", "id", "bucket", "t", "code", "own", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"))
    full = met.join(signed.select("class", "id", "v", "width", "size", "codes"), ["class", "id"])  # by id too: a chance match of hashes mustn't double rows
    dealt = full.select("bucket", "i", "j", "t", "code", "own", "side", "id", "v", "width", "size", "codes").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in _then_none(batches):
            now = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if now is None or not now.num_rows:
                continue
            group = np.stack([now[k].to_numpy() for k in ("bucket", "i", "j")], 1)
            cuts = np.flatnonzero((np.diff(group, axis=0) != 0).any(1)) + 1
            last = len(group) if b is None else (int(cuts[-1]) if len(cuts) else 0)
            held = None if b is None else now.slice(last)
            if not last:
                continue
            now = now.slice(0, last)
            bounds = [0, *cuts[cuts < last].tolist(), last]
            t, code, own, side, size, ids, i, j = (now[k].to_numpy(zero_copy_only=False) for k in ("t", "code", "own", "side", "size", "id", "i", "j"))
            c = now["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, plan.tables, plan.probes)
            width, raw = now["width"].to_numpy(), now["v"].combine_chunks()
            out_id, out_n, out_to = [], [], []
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s < 2:
                    continue
                v = _unit(raw.slice(s, e - s), int(width[s]))
                counts, forest = _meet(int(t[s]), int(code[s]), own[s:e], side[s:e], bool(i[s] != j[s]), v, c[s:e], size[s:e], least)
                hit = np.flatnonzero(counts)
                out_id += ids[s + hit].tolist()
                out_n += counts[hit].tolist()
                out_to += [None] * len(hit)
                for x, y in forest:
                    out_id.append(int(ids[s + x]))
                    out_n.append(0)
                    out_to.append(int(ids[s + y]))
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_to, pa.int64())], ["id", "links", "to"])

    found = table(dealt.mapInArrow(run, "id long, links long, to long"), "vector-links")
    links = found.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = classes.select("label", "v", "id", "size").join(links, "id", "left").join(comps, "id", "left")
    named = named.select("label", "v", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    near = given.alias("g").join(named.alias("c"), (F.col("g.label") == F.col("c.label")) & (F.col("g.v") == F.col("c.v")), "left")
    alone = F.coalesce("component", "g.id")
    return near.select(F.col("g.id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("g.id").isNotNull(), alone).alias("component_id"), F.coalesce(F.col("g.id") == alone, F.lit(True)).alias("kept"))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
