"""Cubes, physical losses, streamlines and GeoJSON against plain loops."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo as G
from skyloom.operators import cube as C
from skyloom.operators import fields as FL
from skyloom.operators.streamlines import Field, lines_of, streamlines

ROWS, COLS = 5, 7


def filled(values):
    known = [k for k, v in enumerate(values) if v is not None]
    near = lambda k: min(known, key=lambda j: ((k // COLS - j // COLS) ** 2 + (k % COLS - j % COLS) ** 2, j))
    return [values[near(k)] for k in range(ROWS * COLS)] if known else values


def test_gaps_take_the_nearest_cell(spark):
    rng = random.Random(3)
    arrays = [[rng.random() if rng.random() < p else None for _ in range(ROWS * COLS)] for p in (0.05, 0.2, 0.5, 0.95, 1.0, 0.0)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate([*arrays, None])], "i int, a array<double>")
    got = {r["i"]: r["a"] for r in df.select("i", C.nearest_known(F.col("a"), ROWS, COLS).alias("a")).collect()}
    assert [got[i] for i in range(6)] == [filled(a) for a in arrays[:-1]] + [got[5]]
    assert all(v is None or math.isnan(v) for v in got[5]) and got[6] is None


def test_a_stack_has_every_channel_at_every_moment(spark):
    rows = [(1, "pm25", 0, 0, 2.0), (1, "pm25", 0, 0, 4.0), (1, "pm25", 4, 6, 9.0), (1, "pm25", 2, 2, None), (1, "pm25", 9, 9, 99.0), (1, "pm25", -1, 0, 99.0), (1, "other", 0, 0, 7.0), (2, "pbl", 1, 1, float("nan")), (2, "rh", 3, 3, 5.0)]
    values = spark.createDataFrame(rows, "hour int, channel string, gy int, gx int, value double").withColumn("cells", F.lit("x"))
    got = {(r["hour"], r["channel"]): r for r in C.stack(values, ROWS, COLS).collect()}
    assert len(got) == 24 and [c for (h, c), r in sorted(got.items(), key=lambda x: x[1]["place"]) if h == 1] == list(C.CHANNELS)
    pm = got[1, "pm25"]
    assert pm["gaps"] == 33 and pm["cells"] == filled([3.0] + [None] * 33 + [9.0])
    assert got[1, "rh"]["cells"] == [0.0] * 35 and got[2, "rh"]["cells"] == [5.0] * 35
    assert got[2, "pbl"]["gaps"] == 35 and all(v is None or math.isnan(v) for v in got[2, "pbl"]["cells"])
    assert C.stack(values.limit(0), ROWS, COLS).count() == 0
    wide = C.fields(C.stack(values, ROWS, COLS), COLS, ["pm25", "rh"]).where("hour = 1").orderBy("gy", "gx").collect()
    assert [r["pm25"] for r in wide] == pm["cells"] and [(r["gy"], r["gx"]) for r in wide] == [divmod(k, COLS) for k in range(35)]


def plain_losses(p, t):
    """p and t: (lead, cell, channel) arrays in the order of SCALES; what the loss is in whole-array form."""
    scale = np.array(list(C.SCALES.values()))
    d = (p - t) / scale
    still = np.hypot(p[..., 1], p[..., 2]) / 20 < 2.0 / 20
    drop = np.maximum(0, -(p[1:, :, 0] - p[:-1, :, 0]) / 500) * (still & (p[..., 3] < 400))[:-1]
    miss = (t[..., 0] - p[..., 0]) / 500
    severe = (t[..., 3] < 400) & (t[..., 0] > 300)
    asym = np.where(miss > 0, 2.0, 0.5) * miss**2 * severe
    return {"mse": (d**2).mean(2), "mae": abs(d).mean(2), "conservation": drop, "inversion": asym, "severe": severe}


def test_losses_equal_whole_arrays(spark):
    rng = np.random.default_rng(2)
    leads, cells = 6, 12
    make = lambda: np.stack([rng.uniform(200, 500, (leads, cells)), rng.normal(0, 2, (leads, cells)), rng.normal(0, 2, (leads, cells)), rng.uniform(100, 900, (leads, cells))], 2)
    p, t = make(), make()
    rows = lambda a: [(i, k // 4, k % 4, *map(float, a[i, k])) for i in range(leads) for k in range(cells)]
    schema = "lead int, gy int, gx int, pm25 double, u_wind double, v_wind double, pbl double"
    pred, truth = (spark.createDataFrame(rows(a), schema) for a in (p, t))
    want = plain_losses(p, t)
    got = {r["lead"]: r for r in C.physics_losses(pred, truth.withColumn("n", F.lit("x"))).collect()}
    assert set(got) == {None, *range(leads)}
    for lead, r in got.items():
        at = slice(None) if lead is None else slice(lead, lead + 1)
        mse, mae = want["mse"][at].mean(), want["mae"][at].mean()
        cons = want["conservation"][at].mean() if want["conservation"][at].size else None
        inv = want["inversion"][at].sum() / max(1, want["severe"][at].sum())
        assert r["n"] == want["mse"][at].size
        assert r["mse"] == pytest.approx(mse) and r["mae"] == pytest.approx(mae) and r["inversion"] == pytest.approx(inv)
        assert (r["conservation"] is None) == (cons is None) and (cons is None or r["conservation"] == pytest.approx(cons))
        assert r["total"] == pytest.approx(mse + 0.5 * mae + 2 * (cons or 0) + 1.5 * inv)
    # a hole in the leads: what lies before it has nothing to look ahead to; nulls and lone cells don't count
    holed = pred.where("lead <> 3").withColumn("pbl", F.when(~((F.col("lead") == 1) & (F.col("gx") == 0)), F.col("pbl")))
    some = {r["lead"]: r for r in C.physics_losses(holed, truth).collect()}
    assert 3 not in some and some[2]["conservation"] is None and some[1]["n"] == 9 and some[0]["n"] == 12
    assert C.physics_losses(pred.limit(0), truth).count() == 0


def test_losses_of_several_runs_do_not_mix(spark):
    schema = "run string, lead int, gy int, gx int, pm25 double, u_wind double, v_wind double, pbl double"
    falls = [("a", i, 0, 0, 500.0 - 100 * i, 0.0, 0.0, 100.0) for i in range(3)]
    rises = [("b", i, 0, 0, 100.0 + 100 * i, 0.0, 0.0, 100.0) for i in range(3)]
    rows = spark.createDataFrame(falls + rises, schema)
    got = {r["lead"]: r["conservation"] for r in C.physics_losses(rows, rows, ["run"]).collect()}
    assert got == {0: pytest.approx(0.1), 1: pytest.approx(0.1), 2: None, None: pytest.approx(0.1)}


def test_flow_of_each_group_is_the_weighted_mean_of_directions(spark):
    rng = random.Random(6)
    winds = [(rng.choice("ab"), 28 + rng.random(), 77 + rng.random(), rng.uniform(0, 360)) for _ in range(700)] + [("a", None, 77.0, 1.0), ("b", 28.0, 77.0, None)]
    cells = [(i, 28 + i / 5, 77.1 + i / 7) for i in range(5)]
    got = FL.flow(spark.createDataFrame(cells, "k int, lat double, lon double"), spark.createDataFrame(winds, "g string, lat double, lon double, from_deg double"), ["k"], ["g"])
    for r in got.collect():
        u = v = 0.0
        for g, lat, lon, deg in winds:
            if g == r["g"] and lat is not None and deg is not None:
                w = 1 / max(1e-4, (r["lat"] - lat) ** 2 + ((r["lon"] - lon) * FL.LON_SCALE) ** 2)
                u, v = u + w * math.sin(math.radians(deg + 180)), v + w * math.cos(math.radians(deg + 180))
        assert (r["u"], r["v"]) == (pytest.approx(u / math.hypot(u, v)), pytest.approx(v / math.hypot(u, v)))
    assert got.count() == 10


def lattice(f, n=41):
    at = np.linspace(-1, 1, n)
    return Field(*(np.array([[f(x, y)[k] for x in at] for y in at]) for k in (0, 1)))


def test_lines_of_a_whirl_keep_their_distance_from_its_centre():
    found = lines_of(lattice(lambda x, y: (-y, x)), 10, 0.01, 200, 20, 10)
    assert len(found) >= 4
    for line in found:
        radius = [math.hypot(x - 0.5, y - 0.5) for x, y in line]
        assert max(radius) - min(radius) < 2e-3
        steps = [math.dist(a, b) for a, b in zip(line, line[1:], strict=False)]
        assert all(s == pytest.approx(0.01, abs=1e-4) for s in steps)
        turn = [(a[0] - 0.5) * (b[1] - 0.5) - (a[1] - 0.5) * (b[0] - 0.5) for a, b in zip(line, line[1:], strict=False)]
        assert all(t > 0 for t in turn)  # along the flow


def test_lines_share_no_cell_and_cover_the_field():
    rng = random.Random(9)
    a, b = rng.random(), rng.random()
    found = lines_of(lattice(lambda x, y: (math.sin(3 * y + a) + 0.2, math.cos(2 * x + b))), 20, 0.012, 90, 25, 6)
    cells = [{(int(y * 25), int(x * 25)) for x, y in line} for line in found]
    assert len(found) > 10 and sum(map(len, cells)) == len(set().union(*cells))
    assert len(set().union(*cells)) > 0.35 * 25 * 25
    assert all(len(line) >= 6 and len(line) <= 181 for line in found)


def test_streamlines_by_group_with_gaps(spark):
    rows = [(g, i, j, float(g == "east"), float(g == "north")) for g in ("east", "north", "calm") for i in range(6) for j in range(6)]
    rows = [r for r in rows if not (r[0] == "east" and r[2] == 3)] + [("east", 0, 0, None, 1.0), ("east", 99, 0, 1.0, 0.0)]
    got = streamlines(spark.createDataFrame(rows, "g string, gy int, gx int, u double, v double"), 6, 6, ["g"], (28.0, 29.0, 76.0, 78.0), seeds=6, step=0.02, spacing=12, least=3).collect()
    assert {r["g"] for r in got} == {"east", "north"}
    for r in got:
        lats, lons = [p["lat"] for p in r["points"]], [p["lon"] for p in r["points"]]
        still, moving = (lats, lons) if r["g"] == "east" else (lons, lats)
        assert max(still) - min(still) < 1e-9 and all(a < b for a, b in zip(moving, moving[1:], strict=False))
        if r["g"] == "east":  # none crosses the column without a wind
            assert max(lons) < 76 + 2 * 0.6 or min(lons) > 76 + 2 * 0.6
    assert streamlines(spark.createDataFrame([], "g string, gy int, gx int, u double, v double"), 6, 6, ["g"]).count() == 0


def test_feature_collections_are_json(spark):
    rows = [(1, 28.12345, 77.0, 2.5, 'a"b'), (0, 28.0, 77.12345, None, None)]
    df = spark.createDataFrame(rows, "k int, lat double, lon double, value double, name string")
    got = json.loads(df.agg(G.feature_collection(["value", "name"], {"name": "label"}, ["k"]).alias("j")).first()["j"])
    assert got["type"] == "FeatureCollection" and [f["properties"] for f in got["features"]] == [{}, {"value": 2.5, "label": 'a"b'}]
    assert got["features"][1]["geometry"] == {"type": "Point", "coordinates": [77.0, 28.1235]} or got["features"][1]["geometry"]["coordinates"] == [77.0, 28.1234]


def test_splines_of_few_stations_are_one_solve_and_of_many_bounded_ones(spark, monkeypatch):
    rng = random.Random(13)
    cells = [(i, j, 28.2 + i * 0.07, 76.8 + j * 0.08) for i in range(10) for j in range(10)]
    smooth = lambda la, lo: 40 + 30 * math.sin(3 * la) + 20 * math.cos(4 * lo)
    spots = [(28.15 + rng.random() * 0.8, 76.75 + rng.random() * 0.9) for _ in range(900)]
    km = lambda la, lo: (la * 111.0, lo * 97.5)

    def field(n, most):
        rows = [(h, la, lo, smooth(la, lo) + h) for h in (0, 1) for la, lo in spots[:n]] + [(0, None, 77.0, 1.0), (1, 28.5, 77.0, None)]
        got = FL.spline(spark.createDataFrame(rows, "hour int, lat double, lon double, value double"), cells, most=most)
        return {(r["hour"], r["gy"], r["gx"]): r["value"] for r in got.collect()}

    want = FL.thin_plate(np.array([km(*s) for s in spots[:60]]), np.array([smooth(*s) for s in spots[:60]]), np.array([km(la, lo) for _, _, la, lo in cells]))
    few = field(60, 100)
    assert len(few) == 200
    for (i, j, _, _), v in zip(cells, want, strict=True):
        assert few[0, i, j] == pytest.approx(v, abs=1e-6) and few[1, i, j] == pytest.approx(v + 1, abs=1e-6)
    # parted into patches that each see all stations, the blend is the same field
    apart = field(60, 59)
    assert max(abs(apart[0, i, j] - v) for (i, j, _, _), v in zip(cells, want, strict=True)) < 1.0
    many = field(900, 60)
    assert len(many) == 200
    for i, j, la, lo in cells:
        assert many[0, i, j] == pytest.approx(smooth(la, lo), abs=0.5) and many[1, i, j] == pytest.approx(many[0, i, j] + 1, abs=1e-6)
