"""District lattices, ranks by hash, slices nearest in time and published figures against plain loops."""

import datetime as dt
import hashlib
import math
import random

from pyspark.sql import functions as F

from skyloom.operators import lattice as L
from skyloom.operators import selection as SE

DISTRICTS = "frame int, lat double, lon double, pm25 double, wind_dir double, wind_speed double, inversion double"


def drawn(n, frames):
    rng = random.Random(5)
    one = lambda f: (f, rng.uniform(28.2, 29), rng.uniform(76.8, 77.7), rng.uniform(5, 400), rng.uniform(0, 360), rng.uniform(0, 9), rng.random())
    return [one(f) for f in range(frames) for _ in range(n)]


def middle(i, side, low, high):
    return low + (high - low) / side * (i + 0.5)


def test_plumes_drift_with_their_own_winds(spark):
    rows = drawn(5, 2)
    null = (7, 28.5, None, 1.0, 1.0, 1.0, 0.5)
    df = spark.createDataFrame([*rows, rows[0], null, (0, 28.5, 77.0, 9.0, None, 1.0, 0.5)], DISTRICTS).withColumn("s", F.lit("x")).withColumn("gy", F.lit(3))
    got = {(r["frame"], r["gy"], r["gx"]): r for r in L.plume_lattice(df, "frame", 2.0).collect()}
    assert len(got) == 2 * 18 * 18  # a frame of nulls only has no cells
    for (f, y, x), r in got.items():
        lat, lon = middle(y, 18, 28.28, 28.92), middle(x, 18, 76.82, 77.62)
        v = 0.0
        for _, a, b, pm, turn, speed, inv in [d for d in [*rows, rows[0]] if d[0] == f]:
            cy, cx = a - math.cos(math.radians(turn)) * speed / 5 * 0.12, b - math.sin(math.radians(turn)) * speed / 5 * 0.12
            wide = 0.1 + 0.055 * (1 - inv) + speed * 0.012
            v += pm * math.exp(-((lat - cy) ** 2 + (lon - cx) ** 2) / (2 * wide**2))
        assert math.isclose(r["value"], 2 * v / 1.9, rel_tol=1e-9) and math.isclose(r["lat"], lat) and math.isclose(r["lon"], lon)
    assert L.plume_lattice(df.limit(0), "frame").count() == 0


def test_winds_blend_by_distance(spark):
    rows = drawn(4, 1)
    got = L.wind_lattice(spark.createDataFrame(rows, DISTRICTS).drop("pm25"), "frame").collect()
    assert len(got) == 81
    for r in got:
        w = [1 / (0.01 + (r["lat"] - a) ** 2 + (r["lon"] - b) ** 2) for _, a, b, *_ in rows]
        x = sum(k * math.cos(math.radians(d[4])) for k, d in zip(w, rows, strict=True))
        y = sum(k * math.sin(math.radians(d[4])) for k, d in zip(w, rows, strict=True))
        assert math.isclose(r["speed"], sum(k * d[5] for k, d in zip(w, rows, strict=True)) / sum(w), rel_tol=1e-9)
        assert math.isclose(r["dir"], math.degrees(math.atan2(y, x)), rel_tol=1e-9)
    alone = L.wind_lattice(spark.createDataFrame([(0, 28.5, 77.0, 1.0, 40.0, 3.0, 0.5)], DISTRICTS), "frame", side=2).collect()
    assert all(math.isclose(r["dir"], 40) and math.isclose(r["speed"], 3) for r in alone) and len(alone) == 4


def test_ranks_by_hash_are_those_of_a_sort(spark):
    rows = [(g, i, hashlib.md5(f"{g}{i % 300}".encode()).hexdigest()) for g in ("a", None) for i in range(400)] + [("b", 1, None), ("b", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, h string").withColumn("n", F.lit(1)).repartition(5)
    got = {(r["g"], r["i"]): r["rank"] for r in SE.ranked_by_hash(df, ["g"], "h", "i").collect()}
    for g in ("a", "b", None):
        order = sorted([r for r in rows if r[0] == g], key=lambda r: (r[2] is not None, r[2] or "", r[1]))
        assert [got[g, r[1]] for r in order] == list(range(1, len(order) + 1))
    assert SE.ranked_by_hash(df.limit(0), ["g"], "h", "i").count() == 0


def test_slices_are_the_nearest_within_an_hour(spark):
    rng = random.Random(2)
    at = dt.datetime(2024, 1, 1)
    times = sorted({at + dt.timedelta(minutes=rng.randrange(0, 3000, 30)) for _ in range(25)})
    asked = [(i, at + dt.timedelta(minutes=rng.randrange(-120, 3200, 15))) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(asked, "i int, ts timestamp_ntz").withColumn("valid", F.lit("clashes"))
    there = spark.createDataFrame([(t,) for t in [*times, times[0]]] + [(None,)], "valid timestamp_ntz")
    got = {r["i"]: r["valid"] for r in SE.nearest_slice(df, there, "ts", "valid").collect()}
    assert len(got) == 301 and got[300] is None
    for i, t in asked[:-1]:
        near = min(times, key=lambda v: (abs(v - t), v))
        assert got[i] == (near if abs(near - t) <= dt.timedelta(hours=1) else None)
    assert set(r["valid"] for r in SE.nearest_slice(df, there.limit(0), "ts", "valid").collect()) == {None}


def test_figures_are_replaced_once_or_not_at_all(spark):
    rows = [
        ("n 12, top 3.5", "12", "13", "3.5", "3.6", "n 13, top 3.6", None),
        ("n 12, top 12", "12", "13", "x", "y", "n 12, top 12", "12"),  # two hits
        ("n 12, top 3.5", "12", "13", "9", "8", "n 12, top 3.5", "9"),  # no hit: the first change goes too
        ("n 12", "12", "12", "n", "m", "m 12", None),  # nothing to change passes
        ("n 12", "", "1", "n", "m", "n 12", ""),
        ("n 12", None, "1", "n", "m", "n 12", ""),
        ("n 12", "12", None, "n", "m", "n 12", "12"),
        (None, "12", "13", "n", "m", None, "12"),
        ("1 a.b", "a.b", "$1\\", "1 ", "2 ", "2 $1\\", None),  # plain strings, not patterns
    ]
    df = spark.createDataFrame(rows, "line string, a string, b string, c string, d string, want string, refused string")
    p = SE.patched(F.col("line"), [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))])
    for r in df.select(p.alias("p"), "want", F.col("refused").alias("r")).collect():
        assert (r["p"]["text"], r["p"]["refused"]) == (r["want"], r["r"])
