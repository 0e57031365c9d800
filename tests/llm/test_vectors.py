"""Near-duplicate vectors against all pairs."""

import collections

import numpy as np
import pytest

from skyloom.llm.vectors import Scheme, codes, near_vectors


def brute(rows, least=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links, parent = collections.Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, v, la) in enumerate(good):
        for b, w, lb in good[:k]:
            if la == lb and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


def vectors(seed, groups, lone, width=64, noise=0.2):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=width)
        for _ in range(rng.integers(1, 14)):
            out.append((centre + noise * rng.normal(size=width)).tolist())
    out += rng.normal(size=(lone, width)).tolist()
    return [(i, v, int(i % 3)) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [3, 1024])
def test_all_pairs(spark, block):
    rows = vectors(3, 20, 60)
    rows += [(1000, rows[0][1], 0), (1001, [2 * x for x in rows[0][1]], 0), (1002, rows[0][1], None), (1003, None, 0), (1004, [0.0] * 64, 0), (1005, [float("nan")] * 64, 0), (1006, [None] * 64, 0), (1007, [float("inf")] + [0.0] * 63, 0), (1008, [], 0), (1009, [1.0, 2.0], 0), (1010, [1.0, 2.1], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("vec_id", "vec_id")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(d, block=block).collect()}
    want = brute(rows)
    assert got == want


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(2000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    for rows in (1000, 10**7):
        s = Scheme.of(rows, 64)
        x, y = codes(a, s), codes(c, s)
        met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
        assert met.mean() > 0.995


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, id int, class string, bucket int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    one = near_vectors(spark.createDataFrame([(7, [1.0, 0.0], 1, 1, "x", 1), (None, [1.0, 0.0], 1, 1, "x", 1)], schema)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in one) == [(-1, 0, None, True), (7, 0, 7, True)]
