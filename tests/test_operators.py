"""Operators against brute force on small, awkward tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import fires as FI
from skyloom.operators import matching as M
from skyloom.operators import rollup as R
from skyloom.operators import spatial as SP
from skyloom.operators import store as ST
from skyloom.operators import timeseries as S
from skyloom.sources.scratch import written

H0 = dt.datetime(2025, 11, 1)


def hourly(spark, series):
    """series: station -> list of values, None for a missing row."""
    rows = [(s, H0 + dt.timedelta(hours=i), float(v)) for s, vs in series.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "station_id long, hour timestamp_ntz, value double")


def by_station(df, column="value"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["station_id"], r["hour"])):
        out.setdefault(r["station_id"], []).append(r[column])
    return out


@pytest.mark.parametrize("values, want", [((7080, 174, 150), (None, 174, 150)), ((819, 393, 100), (819, 393, 100)), ((870, 174, 50), (None, 174, 50)), ((200, 10, 5), (200, 10, 5)), ((600, 200, 9), (600, 200, 9)), ((900,), (900,)), ((900, 900, 10), (900, 900, 10))])
def test_despike(spark, values, want):
    got = by_station(S.despike(hourly(spark, {i: [v] for i, v in enumerate(values)})))
    assert [got[i][0] for i in range(len(values))] == list(want)


@pytest.mark.parametrize(
    "values, want",
    [
        ([9, 2, 2, 2, 2, 2, 9], [9, 2, 2, 2, 2, 2, 9]),
        ([9, 2, 2, 2, 2, 2, 2, 9], [9, *[None] * 6, 9]),
        ([2] * 6, [None] * 6),
        ([5] * 7, [5] * 7),
        ([2, 2, 2, None, 2, 2, 2], [2, 2, 2, None, 2, 2, 2]),
    ],
)
def test_drop_stuck(spark, values, want):
    d = S.densify(hourly(spark, {1: values}), ["station_id"])
    assert by_station(S.drop_stuck(d, ["station_id"]))[1] == want


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    values = [rng.choice([None, rng.randint(1, 99)]) if rng.random() < 0.4 else rng.randint(1, 99) for _ in range(90)]
    values[0] = values[-1] = 50
    d = S.densify(hourly(spark, {1: values}), ["station_id"])
    spec = S.series(["station_id"])

    def mean(xs, least):
        xs = [x for x in xs if x is not None]
        return sum(xs) / len(xs) if len(xs) >= least else None

    want24 = [mean(values[max(0, i - 23) : i + 1], 16) for i in range(90)]
    eight = [mean(values[max(0, i - 7) : i + 1], 6) for i in range(90)]
    want8 = [max((e for e in eight[max(0, i - 23) : i + 1] if e is not None), default=None) for i in range(90)]
    same = lambda a, b: all((x is None) == (y is None) and (x is None or math.isclose(x, y)) for x, y in zip(a, b, strict=True))
    assert same(by_station(d.withColumn("m", S.trailing_mean(F.col("value"), spec, 24, 16)), "m")[1], want24)
    assert same(by_station(S.index_window(d, ["station_id"], F.lit(True)), "windowed")[1], want8)


def test_fill_and_interpolation(spark):
    d = S.densify(hourly(spark, {1: [4, None, None, 10, None, 3], 2: [1, None, 2]}), ["station_id"], whole=True)
    spec, backwards = S.series(["station_id"]), S.series(["station_id"], backwards=True)
    assert by_station(d.withColumn("f", S.filled(F.col("value"), spec, backwards)), "f") == {1: [4, 4, 4, 10, 10, 3], 2: [1, 1, 2, 2, 2, 2]}
    assert by_station(d.withColumn("f", S.interpolated(F.col("value"), F.col("hour"), spec, backwards)), "f") == {1: [4, 6, 8, 10, 6.5, 3], 2: [1, 1.5, 2, 2, 2, 2]}


def test_history_trims_all_alike(spark):
    d = hourly(spark, {1: [None, None, 3, 4], 2: [None, 7, None, 8]})
    end = F.lit(H0 + dt.timedelta(hours=3)).cast("timestamp_ntz")
    got = {r["station_id"]: r["window"] for r in S.history(d, ["station_id"], end, 4, trim=True).collect()}
    assert got == {1: [None, 3, 4], 2: [7, None, 8]}
    assert {r["station_id"]: len(r["window"]) for r in S.history(d, ["station_id"], end, 24).collect()} == {1: 24, 2: 24}


def test_index_validity_and_ties(spark):
    rows = [(1, "pm25", 60.0), (1, "no2", 80.0), (1, "o3", 20.0), (2, "pm25", 60.0), (2, "no2", 10.0), (3, "no2", 10.0), (3, "so2", 10.0), (3, "o3", 10.0), (4, "pm10", None), (4, "o3", 1.0)]
    d = spark.createDataFrame(rows, "station_id long, parameter string, windowed double")
    got = {r["station_id"]: r for r in R.station_index(d, ["station_id"]).collect()}
    assert (got[1]["valid"], got[1]["aqi"], got[1]["prominent"], got[1]["category"]) == (True, 100, "pm25", "Satisfactory")
    assert not got[2]["valid"] and got[2]["aqi"] is None and "2 usable" in got[2]["reasons"]
    assert got[3]["reasons"] == "neither PM2.5 nor PM10"
    assert got[4]["n_pollutants"] == 1 and ";" in got[4]["reasons"]


def places(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, 28.2 + rng.random() * 0.7, 76.8 + rng.random() * 0.8) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lon double")


def km(a, b):
    return math.hypot((a[1] - b[1]) * 111.0, (a[2] - b[2]) * 97.5)


def test_matching_by_distance(spark):
    a, da = places(spark, 60, 1)
    b, db = places(spark, 70, 2)
    near = {(x[0], y[0]): km(x, y) for x in a for y in b if km(x, y) <= 6}
    p = M.pairs_within(da, db, 6.0)
    assert {(r["a"], r["b"]) for r in p.collect()} == set(near)
    assert {r["id"] for r in M.without_near(da, db, 6.0).collect()} == {x[0] for x in a} - {i for i, _ in near}
    greedy, ua, ub = set(), set(), set()
    for (i, j), _ in sorted(near.items(), key=lambda kv: kv[1]):
        if i not in ua and j not in ub:
            greedy.add((i, j)), ua.add(i), ub.add(j)
    assert {(r["a"], r["b"]) for r in M.exclusive(p, ["km"], ["km"]).collect()} == greedy
    serial, used = set(), set()
    for x in a:
        free = [(d, j) for (i, j), d in near.items() if i == x[0] and j not in used]
        if free:
            used.add(min(free)[1]), serial.add((x[0], min(free)[1]))
    assert {(r["a"], r["b"]) for r in M.exclusive(p, ["km"], []).collect()} == serial


def crowd(spark, n, first):
    """Many places at few spots, whose ids alternate between the spots and whose distances tie."""
    rows = [(first + i, 28.2 + i * 37 % 7 / 64, 76.8 + i * 53 % 8 / 64) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lon double")


def test_matching_of_places_at_the_same_spots(spark, monkeypatch):
    a, da = crowd(spark, 300, 10)
    b, db = crowd(spark, 170, 5000)
    near = {(x[0], y[0]): km(x, y) for x in a for y in b if km(x, y) <= 6}
    serial, used = {}, set()
    for x in a:
        free = [(d, j) for (i, j), d in near.items() if i == x[0] and j not in used]
        if free:
            serial[x[0]] = min(free)[1]
            used.add(min(free)[1])
    for turns, blocks in ((1000, 1), (70, 5)):  # in one block and in several
        tables = []
        monkeypatch.setattr(M, "written", lambda df, name: tables.append(name) or written(df, name))
        got = M.in_turn(da, db, 6.0, turns).collect()
        assert {r["a"]: r["b"] for r in got} == serial and len(got) == len(serial)
        assert tables.count("won") == blocks
    greedy, ua, ub = {}, set(), set()
    for (i, j), _ in sorted(near.items(), key=lambda kv: (kv[1], kv[0])):
        if i not in ua and j not in ub:
            greedy[i] = j
            ua.add(i), ub.add(j)
    words = lambda d, *w: d.withColumn("words", F.array(*map(F.lit, w), F.col("id").cast("string")))
    x = M.alike(words(da, "station", "dpcc"), words(db, "station", "cpcb"))
    assert x.select("group").distinct().count() == 56
    p = M.pairs_within(x.where("id = `group`"), db, 6.0)
    tables.clear()
    got = M.exclusive(p, ["km"], ["km"], x.select(F.col("group").alias("a"), "id")).collect()
    assert {r["a"]: r["b"] for r in got} == greedy and len(got) == len(greedy)
    assert tables.count("lost") < 10
    assert M.alike(words(da, "north"), words(db, "south")).where("size(words) > 0").isEmpty()


def test_nearest_in_time_prefers_the_earlier(spark):
    t = lambda h: H0 + dt.timedelta(hours=h)
    left = spark.createDataFrame([(1, t(5)), (1, t(0)), (1, t(90)), (2, t(5))], "k long, at timestamp_ntz")
    right = spark.createDataFrame([(1, t(4)), (1, t(6)), (1, t(1))], "k long, at timestamp_ntz")
    got = {(r["k"], r["at"]): r["nearest"] for r in M.nearest_in_time(left, right, ["k"], "at", 36).collect()}
    assert got == {(1, t(5)): t(4), (1, t(0)): t(1), (1, t(90)): None, (2, t(5)): None}


def test_plume_properties(spark):
    grid = SP.grid(spark, 8, 8)
    fire = lambda n, f: spark.createDataFrame([(30.9, 75.8, f)] * n, "lat double, lon double, frp double")
    total = lambda fires, u, v: SP.plume(grid, fires, u, v).agg(F.sum("smoke")).first()[0]
    one = total(fire(1, 10.0), 2.0, -3.0)
    assert one > 0
    assert total(fire(10, 10.0), 2.0, -3.0) == pytest.approx(10 * one)
    assert total(fire(1, 100.0), 2.0, -3.0) == pytest.approx(10 * one)
    assert total(fire(1, 10.0), 4.0, -6.0) == pytest.approx(one / 2)
    assert total(fire(1, 10.0), -2.0, 3.0) == 0
    assert total(fire(1, 10.0), 0.4, -0.5) == 0
    assert total(fire(1, 10.0), 0.0, 0.0) >= 0
    frp = lambda u, v: SP.plume(grid, fire(1, 10.0), u, v).agg(F.sum("frp")).first()[0]
    assert frp(2.0, -3.0) == pytest.approx(frp(-1.0, 5.0))


def test_fire_totals_close(spark):
    rng = random.Random(9)
    rows = [(27 + rng.random() * 5, 74 + rng.random() * 4, rng.random() * 50, "2025-11-05", "709", rng.choice(["l", "n", None])) for _ in range(300)]
    d = spark.createDataFrame(rows, "lat double, lon double, frp double, acq_date string, acq_time string, confidence string")
    c = FI.clusters(d, most=5)
    listed, rest = c.where("listed").agg(F.sum("pixels"), F.sum("frp_total"), F.count("*")).first(), FI.others(c).first()
    assert listed[2] == 5 and listed[0] + rest["pixels"] == 300
    assert listed[1] + rest["frp_total"] == pytest.approx(sum(r[2] for r in rows))
    assert FI.thinned(d, 1000).count() == 300 and FI.thinned(d, 40).count() == 40


def test_stores(spark):
    old = spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "k long, v long, t long")
    new = spark.createDataFrame([(2, 21, 1), (2, 22, 2), (3, 31, 1), (3, 30, 0)], "k long, v long, t long")
    fresh, counts = ST.insert_absent(old, new, ["k"], "t")
    assert [tuple(r) for r in fresh.collect()] == [(3, 30, 0)] and tuple(counts.first()) == (1, 3)
    once = ST.upsert(old, new, ["k"], "t")
    assert sorted(map(tuple, once.collect())) == [(1, 10, 0), (2, 22, 2), (3, 31, 1)]
    assert sorted(map(tuple, ST.upsert(once, new, ["k"], "t").collect())) == sorted(map(tuple, once.collect()))


def test_qualified_names(spark):
    d = spark.createDataFrame([(1, "Pusa", "IMD"), (2, "Pusa", "DPCC"), (3, "Pusa", None), (4, "Rohini", "IMD"), (5, "Okhla", None), (6, "Okhla", None)], "id long, name string, agency string")
    got = {r["id"]: r["name"] for r in ST.qualified(d, "name", "agency", "id").collect()}
    assert got == {1: "Pusa · IMD", 2: "Pusa · DPCC", 3: "Pusa", 4: "Rohini", 5: "Okhla · 5", 6: "Okhla · 6"}


def test_spline_goes_through_its_stations(spark):
    from skyloom.operators.fields import spline

    rng = random.Random(3)
    rows, _ = places(spark, 7, 5)
    vals = [rng.random() * 100 for _ in rows]
    d = spark.createDataFrame([(H0, r[1], r[2], v) for r, v in zip(rows, vals, strict=True)] + [(H0 + dt.timedelta(hours=1), rows[0][1], rows[0][2], 5.0)], "hour timestamp_ntz, lat double, lon double, value double")
    cells = [(i, 0, r[1], r[2]) for i, r in enumerate(rows)]
    got = {(r["hour"], r["gy"]): r["value"] for r in spline(d, cells).collect()}
    assert all(got[H0, i] == pytest.approx(v, abs=1e-6) for i, v in enumerate(vals))
    assert all(got[H0 + dt.timedelta(hours=1), i] == pytest.approx(5.0) for i in range(7))


def test_scenarios(spark):
    from skyloom.operators import scenario as SC

    d = spark.createDataFrame(SC.DISTRICTS, SC.DISTRICT_SCHEMA)
    base, less = SC.frames(d).cache(), SC.frames(d, 50, 50, 50).cache()
    assert base.count() == 5 * 73 and base.where("pm25 < 6 or pm25 > 780 or inversion < 0 or inversion > 1").count() == 0
    assert less.agg(F.avg("pm25")).first()[0] < base.agg(F.avg("pm25")).first()[0]
    live = base.select("district", "hour", "pm25", "inversion")
    same = SC.with_interventions(live, base, base).join(live.withColumnRenamed("pm25", "was"), ["district", "hour"])
    assert same.where("abs(pm25 - was) > 1e-9").count() == 0


def test_left_out_uses_the_others_only(spark):
    rows, st = places(spark, 5, 11)
    v = spark.createDataFrame([(i, H0, 10.0 * (i + 1)) for i in range(4)], "id long, hour timestamp_ntz, value double")
    got = {r["id"]: r for r in SP.left_out(st, v).collect()}
    for i in range(4):
        others = sorted((km(rows[i], rows[j]), j) for j in range(4) if j != i)
        w = [(1 / d**2, 10.0 * (j + 1)) for d, j in others]
        assert got[i]["idw"] == pytest.approx(sum(a * b for a, b in w) / sum(a for a, _ in w))
        assert got[i]["nearest"] == 10.0 * (others[0][1] + 1)


@pytest.mark.parametrize("apart", [False, True])
def test_neighbours_are_the_nearest(spark, apart):
    a, da = places(spark, 40, 21)
    b, db = places(spark, 90, 22)
    b += [(90 + i, 29.9, 78.9) for i in range(12)] + [(200, b[0][1], b[0][2])]  # a far cluster at one spot, and a twin
    db = spark.createDataFrame([*b, (300, None, 77.0)], "id long, lat double, lon double")
    a += [(40, 28.5, 77.1), (41, 29.9, 78.9), (42, 26.0, 74.0)]
    da = spark.createDataFrame([*a, (43, None, None)], "p long, lat double, lon double")
    for k in (1, 5, 200):
        got = {}
        for r in M.neighbours(da, db, k, ["p"], apart).collect():
            got.setdefault(r["p"], {})[r["rank"]] = r["id"]
        for x in a:
            ranked = sorted((km(x, y), y[0]) for y in b if not (apart and y[0] == x[0]))
            if k == 200:  # ties at one spot: only those that can be among the k are kept
                assert got[x[0]] == {i + 1: j for i, (_, j) in enumerate(ranked)}
            else:
                assert got[x[0]] == {i + 1: j for i, (_, j) in enumerate(ranked[:k])}
        assert 43 not in got
    assert M.neighbours(da, db.limit(0), 3, ["p"]).count() == 0
    assert M.neighbours(da.limit(0), db, 3, ["p"]).count() == 0


def test_plume_equals_a_sum_over_fires(spark):
    rng = random.Random(4)
    fires = [(27 + rng.random() * 4, 75 + rng.random() * 3, rng.random() * 30) for _ in range(30)]
    d = spark.createDataFrame([*fires, fires[0], (None, 75.0, 1.0), (28.0, 75.0, None)], "lat double, lon double, frp double")
    got = {(r["gy"], r["gx"]): (r["frp"], r["smoke"]) for r in SP.plume(SP.grid(spark, 5, 6), d, 3.0, -4.0).collect()}
    for c in SP.grid(spark, 5, 6).collect():
        frp = smoke = 0.0
        for la, lo, f in [*fires, fires[0]]:
            dx, dy = (c["lon"] - lo) * 97.5, (c["lat"] - la) * 111.0
            along, across = dx * 0.6 - dy * 0.8, abs(dy * 0.6 + dx * 0.8)
            frp += 0.22 * f * math.exp(-(dx * dx + dy * dy) / 4050)
            if along > 0 and along / 18 <= 72:
                smoke += 0.22 * f * math.exp(-across * across / 4050) / (1 + along / 200) * 0.4
        assert got[c["gy"], c["gx"]] == pytest.approx((frp, smoke))


def test_contours_become_smooth_lines(spark):
    from skyloom.operators.fields import contours, polylines

    hill = [(y, x, 10.0 - math.hypot(y - 6.2, x - 7.1)) for y in range(14) for x in range(15)]
    slope = [(y, x, float(x) + 0.3) for y in range(6) for x in range(6)]
    rings = contours(spark.createDataFrame(hill, "gy int, gx int, value double"), 6.0).selectExpr("'hill' as field", "*")
    lines = contours(spark.createDataFrame(slope, "gy int, gx int, value double"), 2.0).selectExpr("'slope' as field", "*")
    rough = {r["field"]: r for r in polylines(rings.unionByName(lines), ["field"], 0).collect()}
    assert rough["hill"]["closed"] and len(rough["hill"]["points"]) == rings.count() + 1
    assert not rough["slope"]["closed"] and [(p["x"], p["y"]) for p in rough["slope"]["points"]] == [pytest.approx((1.7, float(y))) for y in range(6)]
    smooth = {r["field"]: r for r in polylines(rings.unionByName(lines), ["field"]).collect()}
    assert smooth["hill"]["points"][0] == smooth["hill"]["points"][-1] and len(smooth["hill"]["points"]) == 4 * rings.count() + 1
    assert all(abs(math.hypot(p["y"] - 6.2, p["x"] - 7.1) - 4) < 0.1 for p in smooth["hill"]["points"])
    assert smooth["slope"]["points"][0] == rough["slope"]["points"][0] and smooth["slope"]["points"][-1] == rough["slope"]["points"][-1]
    assert polylines(lines.limit(0), ["field"]).count() == 0


def test_flow_turns_through_north(spark):
    from skyloom.operators.fields import flow

    cells = spark.createDataFrame([(0, 0, 28.5, 77.0)], "gy int, gx int, lat double, lon double")
    winds = lambda *b: spark.createDataFrame([(28.5, 77.0 + d, x) for d, x in b], "lat double, lon double, from_deg double")
    r = flow(cells, winds((-0.1, 350.0), (0.1, 10.0))).first()
    assert (r["u"], r["v"]) == pytest.approx((0.0, -1.0), abs=1e-9)
    r = flow(cells, winds((0.0, 90.0))).first()
    assert (r["u"], r["v"]) == pytest.approx((-1.0, 0.0), abs=1e-9)
    r = flow(cells, winds((0.0, 90.0)).limit(0)).first()
    assert (r["u"], r["v"]) == (0.7071, -0.7071)
