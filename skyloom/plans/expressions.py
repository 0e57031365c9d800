"""Queries of the expression families P and X, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import index as X
from ..functions import parse as P
from ..functions import tables as T
from ..functions import weather as W
from ..sources.bridge import SMALL, observations, pixels, read, sql, stations
from .registry import Registry

REG = Registry()
query = REG.query


def ladder_sql(x: str, bands, half_open: bool = False) -> str:
    parts = " ".join(f"WHEN {x} >= {a}::DOUBLE AND {x} {'<' if half_open else '<='} {b}::DOUBLE THEN ({x} - {a}::DOUBLE) * (({d - c})::DOUBLE / ({b}::DOUBLE - {a}::DOUBLE)) + {c}::DOUBLE" for a, b, c, d in bands)
    return f"CASE {parts} END"


def index_sql(pollutant: str, x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN coalesce(round_even({ladder_sql(x, T.SUB_INDEX[pollutant])}, 0)::INTEGER, 500) END"


def index_by_sql(parameter: str, x: str) -> str:
    return f"CASE {parameter} {' '.join(f"WHEN '{p}' THEN {index_sql(p, x)}" for p in T.POLLUTANTS)} END"


CATEGORY_SQL = "CASE WHEN {0} <= 50 THEN 'Good' WHEN {0} <= 100 THEN 'Satisfactory' WHEN {0} <= 200 THEN 'Moderate' WHEN {0} <= 300 THEN 'Poor' WHEN {0} <= 400 THEN 'Very Poor' WHEN {0} IS NOT NULL THEN 'Severe' END"


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, SMALL)


@query("x1_sub_index", sql(f"SELECT event_id, parameter, {index_by_sql('parameter', '(value * 1.3 - 5)')} AS sub_index FROM obs", "obs"))
def x1(spark, sf_dir):
    c = F.col("value") * 1.3 - 5
    return _obs(spark, sf_dir).select("event_id", "parameter", X.by_pollutant(F.col("parameter"), lambda p: X.sub_index(p, c)).alias("sub_index"))


@query("x2_category", sql(f"SELECT event_id, {CATEGORY_SQL.format('(value * 2)')} AS category FROM obs", "obs"))
def x2(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.category(F.col("value") * 2).alias("category"))


_p3 = "round_even(value / 0.7, 1)"
X3_SQL = "coalesce(round_even(CASE WHEN {0} > 350 THEN ({0} - 250.1::DOUBLE) * (99::DOUBLE / (350.0::DOUBLE - 250.1::DOUBLE)) + 401 ELSE {1} END, 0)::INTEGER, 0)"


@query("x3_policy_index", sql(f"SELECT event_id, {X3_SQL.format('c', ladder_sql('c', T.POLICY_PM25))} AS aqi FROM (SELECT event_id, {_p3} AS c FROM obs)", "obs"))
def x3(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.policy_index(F.col("value") / 0.7).alias("aqi"))


def _x4(p: str, x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN CASE WHEN {x} > {T.GAPPED[p][-1][1]} THEN 500.0::DOUBLE ELSE round_even({ladder_sql(x, T.GAPPED[p])}, 1) END END"


@query(
    "x4_ingest_index",
    sql(
        f""", s AS (SELECT event_id, {_x4("pm25", "value")} AS a, {_x4("pm10", "value * 2")} AS b, {_x4("nox", "value * 1.5")} AS c, {_x4("o3", "value / 2")} AS d FROM obs)
        SELECT event_id, greatest(a, b, c, d) AS aqi, CASE greatest(a, b, c, d) WHEN a THEN 'PM2.5' WHEN b THEN 'PM10' WHEN c THEN 'NOx' WHEN d THEN 'O3' END AS dominant FROM s""",
        "obs",
    ),
)
def x4(spark, sf_dir):
    v = F.col("value")
    return _obs(spark, sf_dir).select("event_id", X.ingest_index(v, v * 2, v * 1.5, v / 2).alias("x")).select("event_id", "x.*")


@query("x5_client_index", sql(f"SELECT event_id, floor(coalesce({ladder_sql('value', T.CLIENT_PM25, True)}, (value - 250) * (99.0::DOUBLE / 750) + 401) + 0.5)::INTEGER AS aqi FROM obs", "obs"))
def x5(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.client_index(F.col("value")).alias("aqi"))


def _x6(p: str, i: str) -> str:
    w = " ".join(f"WHEN {i} BETWEEN {c} AND {d} THEN round_even(({i} - {c}) * (({b}::DOUBLE - {a}::DOUBLE) / {d - c}) + {a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) / {d - c} / 2, 2)" for a, b, c, d in T.FOREIGN[p])
    return f"CASE {w} ELSE {T.FOREIGN[p][-1][1]}::DOUBLE END"


@query("x6_from_foreign_index", sql(f"SELECT event_id, {_x6('pm25', 'i')} AS pm25, {_x6('pm10', 'i')} AS pm10, {_x6('o3', 'i')} AS o3 FROM (SELECT event_id, floor(value * 1.2)::INTEGER AS i FROM obs)", "obs"))
def x6(spark, sf_dir):
    d = _obs(spark, sf_dir).select("event_id", F.floor(F.col("value") * 1.2).cast("int").alias("i"))
    return d.select("event_id", *[X.from_foreign(p, F.col("i")).alias(p) for p in ("pm25", "pm10", "o3")])


def _x7(i: str) -> str:
    w = " ".join(f"WHEN least({i}, 500) BETWEEN {c} AND {d} THEN (least({i}, 500) - {c}) * ({b - a}::DOUBLE / {d - c}) + {a} + CASE WHEN {c} > 0 AND least({i}, 500) = {c} THEN {b - a}::DOUBLE / {d - c} / 4 ELSE 0 END" for a, b, c, d in T.SUB_INDEX["pm25"])
    return f"CASE WHEN {i} >= 0 THEN CASE {w} END END"


@query("x7_pm25_of_index", sql(f"SELECT event_id, {_x7('i')} AS pm25 FROM (SELECT event_id, floor(value * 1.3 - 3)::INTEGER AS i FROM obs)", "obs"))
def x7(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.pm25_of_index(F.floor(F.col("value") * 1.3 - 3).cast("int")).alias("pm25"))


_x8 = " ".join(f"WHEN i BETWEEN {c} AND {d} THEN (i - {c}) * (({b}::DOUBLE - {a}::DOUBLE) / {d - c}) + {a}::DOUBLE" for a, b, c, d in T.POLICY_PM25)


@query("x8_pm25_roughly", sql(f"SELECT event_id, CASE {_x8} ELSE 350.0::DOUBLE END AS pm25 FROM (SELECT event_id, floor(value * 1.3)::INTEGER AS i FROM obs)", "obs"))
def x8(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.pm25_roughly(F.floor(F.col("value") * 1.3).cast("int")).alias("pm25"))


_x9 = " ".join((f"WHEN i <= {t} THEN" if t else "ELSE") + " {'stage': " + str(s) + f", 'category': '{n}', 'actions': " + "[" + ", ".join(f"'{a}'" for a in acts) + "]}" for t, s, n, acts in T.STAGES)


@query("x9_policy_stage", sql(f"SELECT event_id, s.stage AS stage, s.category AS category, len(s.actions)::INTEGER AS n_actions, s.actions[1] AS first_action FROM (SELECT event_id, CASE {_x9} END AS s FROM (SELECT event_id, floor(value * 2)::INTEGER AS i FROM obs))", "obs"))
def x9(spark, sf_dir):
    s = _obs(spark, sf_dir).select("event_id", X.policy_stage(F.floor(F.col("value") * 2).cast("int")).alias("s"))
    return s.select("event_id", "s.stage", "s.category", F.size("s.actions").alias("n_actions"), F.get("s.actions", F.lit(0)).alias("first_action"))


_w = "SELECT event_id, value AS pm25, value * 8 AS pbl, (event_id % 60) / 10.0::DOUBLE AS wind, (event_id % 24)::DOUBLE AS hour, value * 3 AS solar FROM obs"


def _weather(spark, sf_dir):
    v, e = F.col("value"), F.col("event_id")
    return _obs(spark, sf_dir).select("event_id", v.alias("pm25"), (v * 8).alias("pbl"), (e % 60 / F.lit(10.0)).alias("wind"), (e % 24).cast("double").alias("hour"), (v * 3).alias("solar"))


@query(
    "x10_dispersion",
    sql(
        f"""SELECT event_id, coalesce(pbl < 400 AND wind < 2, false) AS inversion, round_even(wind * pbl, 2) AS ventilation,
        CASE WHEN pbl IS NULL OR wind IS NULL THEN 'UNKNOWN' WHEN pbl < 300 AND wind < 1.5 THEN 'CRITICAL' WHEN pbl < 500 AND wind < 2.5 THEN 'HIGH' WHEN pbl < 800 OR wind < 3.5 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM ({_w})""",
        "obs",
    ),
)
def x10(spark, sf_dir):
    return _weather(spark, sf_dir).select("event_id", W.dispersion(F.col("pbl"), F.col("wind")).alias("d")).select("event_id", "d.*")


_clamp = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"
_isi = f"1 / (1 + exp(-8 * (0.45 * {_clamp.format('pm25 / 500')} + 0.35 * {_clamp.format('1 - pbl / 2000')} + 0.2 * {_clamp.format('1 - wind / 10')} - 0.5)))"


@query("x11_inversion_index", sql(f"SELECT event_id, round({_isi}, 6) AS isi FROM ({_w})", "obs"))
def x11(spark, sf_dir):
    return _weather(spark, sf_dir).select("event_id", F.round(W.inversion_index(F.col("pm25"), F.col("pbl"), F.col("wind")), 6).alias("isi"))


@query("x12_alert_level", sql(f"SELECT event_id, CASE WHEN s > 1.65 THEN 'EMERGENCY' WHEN s > 1.2 THEN 'WARNING' WHEN s > 0.8 THEN 'ADVISORY' ELSE 'NOMINAL' END AS level FROM (SELECT event_id, pm25 / 120 + wind / 6 * 0.75 AS s FROM ({_w}))", "obs"))
def x12(spark, sf_dir):
    return _weather(spark, sf_dir).select("event_id", X.alert_level(F.col("pm25"), F.col("wind") / 6).alias("level"))


@query("x13_inversion_severity", sql(f"SELECT event_id, CASE WHEN isi > 0.85 THEN 'EMERGENCY' WHEN isi > 0.75 THEN 'SEVERE' ELSE 'MODERATE' END AS severity FROM (SELECT event_id, {_isi} AS isi FROM ({_w}))", "obs"))
def x13(spark, sf_dir):
    return _weather(spark, sf_dir).select("event_id", W.inversion_severity(W.inversion_index(F.col("pm25"), F.col("pbl"), F.col("wind"))).alias("severity"))


def _x14() -> str:
    rounds, pm = "", "pm25"
    for k in range(3):
        rounds += f""", r{k} AS (SELECT *, least(3.5::DOUBLE, greatest(0.0::DOUBLE, {pm} * 0.007)) AS aod{k} FROM {"w" if k == 0 else f"t{k - 1}"}),
        t{k} AS (SELECT *, {pm} + 0.5 * (pm25 * least(1.6::DOUBLE, greatest(1.0::DOUBLE, pbl0 / greatest(pbl0 + 0.42 * -180.0 * (1 / (1 + exp(-aod{k})) - 0.5), 50.0::DOUBLE))) - {pm}) AS pm{k} FROM r{k})"""
        pm = f"pm{k}"
    d = "(-180.0::DOUBLE * (1 / (1 + exp(-aod2)) - 0.5))"
    return sql(
        f""", w AS (SELECT *, greatest(50.0::DOUBLE, pbl) AS pbl0, hour AS temp FROM ({_w})){rounds}
        SELECT event_id, round(aod2, 6) AS aod, round(pm2, 6) AS pm25_out, round(greatest(0.0::DOUBLE, solar + {d}), 6) AS solar_out, round(greatest(50.0::DOUBLE, pbl0 + 0.42 * {d}), 6) AS pbl_out,
        round(temp + 0.018 * {d}, 6) AS temp_out, round(CASE WHEN pm25 > 0 THEN pm2 / pm25 ELSE 1 END, 6) AS amplification FROM t2""",
        "obs",
    )


@query("x14_feedback", _x14())
def x14(spark, sf_dir):
    out = W.coupled(F.col("pm25"), F.col("solar"), F.col("pbl"), F.col("hour"), amplify=True)
    return _weather(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(k) for k, c in out.items()])


_pct = "floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({}) / 400 * 100)) + 0.5)::INTEGER"


@query(
    "x15_exposure_risk",
    sql(
        f""", s AS (SELECT event_id, floor(value * 2)::INTEGER AS aqi, CASE WHEN event_id % 3 > 0 THEN floor(value)::INTEGER END AS pm25, CASE WHEN event_id % 5 = 0 THEN floor(value * 1.5)::INTEGER END AS co,
        CASE WHEN event_id % 2 = 0 THEN floor(value * 0.7)::INTEGER END AS pm10, CASE WHEN event_id % 4 = 0 THEN floor(value * 1.8)::INTEGER END AS o3 FROM obs),
        r AS (SELECT event_id, unnest([{{'id': 'respiratory', 'pct': {_pct.format("coalesce(pm25, aqi)")}, 'm': pm25 IS NOT NULL}}, {{'id': 'cardio', 'pct': {_pct.format("coalesce(greatest(pm25, co), aqi) * 0.82::DOUBLE")}, 'm': greatest(pm25, co) IS NOT NULL}},
        {{'id': 'irritant', 'pct': {_pct.format("coalesce(pm10, aqi) * 0.9::DOUBLE")}, 'm': pm10 IS NOT NULL}}, {{'id': 'exertion', 'pct': {_pct.format("greatest(aqi, coalesce(o3, 0) * 1.15::DOUBLE) * 1.08::DOUBLE")}, 'm': o3 IS NOT NULL}}]) AS x FROM s)
        SELECT event_id, x.id AS id, x.pct AS pct, CASE WHEN x.pct < 15 THEN 'Minimal' WHEN x.pct < 28 THEN 'Low' WHEN x.pct < 45 THEN 'Moderate' WHEN x.pct < 65 THEN 'Elevated' WHEN x.pct < 85 THEN 'High' ELSE 'Severe' END AS level,
        CASE WHEN x.m THEN 'measured' ELSE 'composite' END AS basis FROM r""",
        "obs",
    ),
)
def x15(spark, sf_dir):
    v, e = F.col("value"), F.col("event_id")
    whole = lambda x: F.floor(x).cast("int")
    none = F.lit(None).cast("int")
    rows = X.exposure_rows(whole(v * 2), F.when(e % 3 > 0, whole(v)), F.when(e % 5 == 0, whole(v * 1.5)), F.when(e % 2 == 0, whole(v * 0.7)), none, none, F.when(e % 4 == 0, whole(v * 1.8)))
    return _obs(spark, sf_dir).select("event_id", F.inline(rows))


@query("x16_alert_stage", sql("SELECT event_id, CASE WHEN value * 3 > 400 THEN 'EMERGENCY' WHEN value * 3 > 300 THEN 'ALERT' WHEN value * 3 > 200 THEN 'WATCH' ELSE 'NONE' END AS stage FROM obs", "obs"))
def x16(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.alert_stage(F.col("value") * 3).alias("stage"))


@query(
    "x17_field_intensity",
    sql(
        f""", w AS ({_w}), f AS (SELECT unnest(['MODEL', 'PM10', 'O3', 'NOx', 'PBL', 'WIND']) AS field)
        SELECT event_id, field, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE field WHEN 'PM10' THEN pm25 * 1.74 / 210 WHEN 'O3' THEN solar / 130 WHEN 'NOx' THEN hour / 150 WHEN 'PBL' THEN 1 - pbl / 1000 WHEN 'WIND' THEN 1 - wind / 6 ELSE pm25 / 120 END)), 9) AS intensity FROM w, f""",
        "obs",
    ),
)
def x17(spark, sf_dir):
    fields = F.explode(F.array(*map(F.lit, ["MODEL", "PM10", "O3", "NOx", "PBL", "WIND"]))).alias("field")
    d = _weather(spark, sf_dir).select("*", fields)
    return d.select("event_id", "field", F.round(W.field_intensity(F.col("field"), F.col("pm25"), F.col("solar"), F.col("hour"), F.col("pbl"), F.col("wind")), 9).alias("intensity"))


@query("x18_coverage_status", sql("SELECT event_id, CASE WHEN value >= 90 THEN 'ok' WHEN value >= 60 THEN 'degraded' ELSE 'offline' END AS status FROM obs", "obs"))
def x18(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", W.coverage_status(F.col("value")).alias("status"))


@query(
    "x19_freshness",
    sql(
        """, c AS (SELECT event_id, ts, CASE WHEN event_id % 7 > 0 THEN date_trunc('day', ts) - (event_id % 3) * INTERVAL 1 DAY END AS started, date_trunc('day', ts) + (event_id % 40) * INTERVAL 1 HOUR AS last_valid FROM obs)
        SELECT event_id, started, CASE WHEN last_valid <= ts THEN 'expired' WHEN started IS NULL THEN 'unknown' WHEN (epoch_us(ts) - epoch_us(started)) / 3.6e9 > 24 THEN 'stale' WHEN (epoch_us(ts) - epoch_us(started)) / 3.6e9 > 6 THEN 'aging' ELSE 'fresh' END AS status FROM c""",
        "obs",
    ),
)
def x19(spark, sf_dir):
    day, e = F.date_trunc("day", "ts").cast("timestamp_ntz"), F.col("event_id")
    ident = F.when(e % 7 > 0, F.concat(F.date_format(F.expr("date_trunc('day', ts) - make_dt_interval(cast(event_id % 3 as int))"), "yyyyMMdd"), F.lit("_00z")))
    d = _obs(spark, sf_dir).select("event_id", "ts", W.cycle_start(ident).cast("timestamp_ntz").alias("started"), (day + F.make_dt_interval(F.lit(0), (e % 40).cast("int"))).alias("last_valid"))
    return d.select("event_id", "started", W.freshness(F.col("last_valid"), F.col("started"), F.col("ts")).alias("status"))


def _hav(lat: str, lon: str, a: float, b: float) -> str:
    return f"2 * {T.EARTH_KM} * asin(least(1.0, sqrt(pow(sin(radians({a} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({a})) * pow(sin(radians({b} - {lon}) / 2), 2))))"


def _bear(lat: str, lon: str, a: float, b: float) -> str:
    y = f"sin(radians({b} - {lon})) * cos(radians({a}))"
    x = f"(cos(radians({lat})) * sin(radians({a})) - sin(radians({lat})) * cos(radians({a})) * cos(radians({b} - {lon})))"
    d = f"(degrees(atan2({y}, {x})) + 360.0)"
    return f"({d} - 360.0 * floor({d} / 360.0))"


_POINTS_SQL = "[" + ", ".join(f"'{p}'" for p in T.POINTS) + "]"


def _compass(d: str) -> str:
    return f"{_POINTS_SQL}[(floor({d} / 22.5 + 0.5)::INTEGER % 16) + 1]"


@query(
    "x20_geometry",
    sql(f""", g AS (SELECT okey, line, {_hav("lat", "lon", *T.TARGET)} AS km, {_bear("lat", "lon", *T.TARGET)} AS deg, sqrt(pow((lat - {T.TARGET[0]}) * 111, 2) + pow((lon - {T.TARGET[1]}) * 97.5, 2)) AS flat FROM px)
    SELECT okey, line, round(km, 6) AS km, round(deg, 6) AS bearing, {_compass("deg")} AS point, round(flat, 6) AS planar FROM g""", "px"),
)
def x20(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    b = G.bearing_deg(lat, lon, *T.TARGET)
    return pixels(spark, sf_dir).select("okey", "line", F.round(G.haversine_km(lat, lon, *T.TARGET), 6).alias("km"), F.round(b, 6).alias("bearing"), G.compass(b).alias("point"), F.round(G.planar_km(lat, lon, *T.TARGET), 6).alias("planar"))


@query(
    "x21_transit",
    sql(f""", g AS (SELECT okey, line, {_hav("lat", "lon", *T.TARGET)} AS km, CASE WHEN line <> 7 THEN cos(radians({_bear("lat", "lon", *T.TARGET)} - (okey % 360))) END AS al, frp / 4 AS kmh FROM px),
    h AS (SELECT *, CASE WHEN al > 0.3 AND kmh > 0.1 THEN km / (kmh * al) END AS hours FROM g)
    SELECT okey, line, CASE WHEN al IS NOT NULL THEN coalesce(hours <= 72, false) END AS carrying, round_even(hours, 1) AS hours, round_even(al, 2) + 0.0 AS alignment, CASE WHEN al IS NOT NULL THEN round_even(km, 1) END AS dist_km FROM h""", "px"),
)
def x21(spark, sf_dir):
    to = F.when(F.col("line") != 7, (F.col("okey") % 360).cast("double"))
    t = G.transit(F.col("lat"), F.col("lon"), to, F.col("frp") / 4)
    return pixels(spark, sf_dir).select("okey", "line", t.alias("t")).select("okey", "line", F.when(F.col("t.alignment").isNotNull(), F.coalesce("t.carrying", F.lit(False))).alias("carrying"), "t.hours", "t.alignment", "t.dist_km")


@query(
    "x22_wind_block",
    sql(f""", w AS (SELECT event_id, sin(event_id) * value / 50 AS u, CASE WHEN event_id % 11 > 0 THEN cos(event_id) * value / 40 END AS v FROM obs),
    g AS (SELECT *, sqrt(u * u + v * v) AS s, degrees(atan2(u, v)) + 360.0 AS d FROM w), k AS (SELECT *, d - 360.0 * floor(d / 360.0) AS t FROM g), b AS (SELECT *, t + 180.0 - 360.0 * floor((t + 180.0) / 360.0) AS f FROM k)
    SELECT event_id, round_even(s, 2) AS speed_ms, round_even(s * 3.6, 1) AS speed_kmh, round_even(t, 1) AS to_deg, {_compass("t")} AS to_compass, round_even(f, 1) AS from_deg, {_compass("f")} AS from_compass FROM b""", "obs"),
)
def x22(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    w = G.wind_block(F.sin(e) * v / 50, F.when(e % 11 > 0, F.cos(e) * v / 40))
    return _obs(spark, sf_dir).select("event_id", w.alias("w")).select("event_id", *[f"w.{k}" for k in ("speed_ms", "speed_kmh", "to_deg", "to_compass", "from_deg", "from_compass")])


@query(
    "x23_day_shapes",
    "SELECT h::DOUBLE AS hour, round(CASE WHEN (h - 6.2) / 11.6 <= 0 OR (h - 6.2) / 11.6 >= 1 THEN 0 ELSE 720 * sin(pi() * (h - 6.2) / 11.6) END, 9) AS solar, round(1 + 0.32 * cos((h - 7) / 24.0 * 2 * pi()), 9) AS diurnal, round(240 + 760 * greatest(0.0, sin((h - 6) / 12.0 * pi())), 9) AS pbl FROM (SELECT DISTINCT hour(ts) AS h FROM events)",
)
def x23(spark, sf_dir):
    h = F.col("hour")
    d = read(spark, sf_dir, "events").select(F.hour("ts").cast("double").alias("hour")).distinct()
    return d.select("hour", F.round(W.clear_sky(h), 9).alias("solar"), F.round(W.diurnal(h), 9).alias("diurnal"), F.round(W.pbl_shape(h), 9).alias("pbl"))


@query("x24_ingest_category", sql(f"SELECT event_id, coalesce({CATEGORY_SQL.format('a')}, 'Unknown') AS category FROM (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN value * 2 END AS a FROM obs)", "obs"))
def x24(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", X.ingest_category(F.when(F.col("event_id") % 9 > 0, F.col("value") * 2)).alias("category"))


@query(
    "x25_station_pm25",
    sql(f""", s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS own, CASE WHEN event_id % 3 = 1 THEN value + 1 END AS conc, CASE WHEN event_id % 4 > 0 THEN floor(value * 1.2)::INTEGER END AS i FROM obs)
    SELECT event_id, coalesce(own, conc, {_x7("i")}) AS value, CASE WHEN coalesce(own, conc) IS NOT NULL THEN 'measured' WHEN {_x7("i")} IS NOT NULL THEN 'index' ELSE 'none' END AS basis FROM s""", "obs"),
)
def x25(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    s = X.station_pm25(F.when(e % 3 == 0, v), F.when(e % 3 == 1, v + 1), F.when(e % 4 > 0, F.floor(v * 1.2).cast("int")))
    return _obs(spark, sf_dir).select("event_id", s.alias("s")).select("event_id", "s.value", "s.basis")


@query("x28_age_text", sql("SELECT event_id, CASE WHEN m < 60 THEN greatest(m, 1)::VARCHAR || 'm' WHEN m // 60 < 24 THEN (m // 60)::VARCHAR || 'h' ELSE (m // 1440)::VARCHAR || 'd' END AS age FROM (SELECT event_id, floor(value * value / 10)::BIGINT AS m FROM obs)", "obs"))
def x28(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", W.age_text(F.col("value") * F.col("value") / 10).alias("age"))


@query("x29_noise", sql("SELECT event_id, round(x - floor(x), 4) AS noise FROM (SELECT event_id, sin((event_id % 1000) * 12.9898::DOUBLE) * 43758.5453::DOUBLE AS x FROM obs)", "obs"))
def x29(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", F.round(W.noise(F.col("event_id") % 1000), 4).alias("noise"))


# ---- P ----
_units = ["ppb", "ppm", "mg/m3", "µg/m³", "ug / m3", "furlong"]
_U = "[" + ", ".join(f"'{u}'" for u in _units) + "]"
_M = "CASE parameter WHEN 'no2' THEN 46.0055 WHEN 'so2' THEN 64.066 WHEN 'o3' THEN 47.997 END"


@query(
    "p1_units",
    sql(f""", u AS (SELECT event_id, parameter, value, {_U}[event_id % 6 + 1] AS unit FROM obs)
    SELECT event_id, unit, round(CASE WHEN unit IN ('ppb', 'ppm') THEN CASE unit WHEN 'ppm' THEN value * 1000 ELSE value END * {_M} / 24.45::DOUBLE WHEN unit = 'mg/m3' THEN value * 1000 WHEN unit <> 'furlong' THEN value END, 6) AS value FROM u""", "obs"),
)
def p1(spark, sf_dir):
    d = _obs(spark, sf_dir).withColumn("unit", F.get(F.array(*map(F.lit, _units)), (F.col("event_id") % 6).cast("int")))
    return d.select("event_id", "unit", F.round(P.to_index_unit(F.col("parameter"), F.col("value"), F.col("unit")), 6).alias("value"))


_raw = "CASE event_id % 6 WHEN 0 THEN 'NA' WHEN 1 THEN '-999' WHEN 2 THEN ' ' || value::VARCHAR WHEN 3 THEN '' WHEN 4 THEN 'nan' ELSE value::VARCHAR END"


def _raw_text(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value").cast("string")
    return _obs(spark, sf_dir).select("event_id", "ts", F.when(e % 6 == 0, "NA").when(e % 6 == 1, "-999").when(e % 6 == 2, F.concat(F.lit(" "), v)).when(e % 6 == 3, "").when(e % 6 == 4, "nan").otherwise(v).alias("raw"))


@query("p2_number", sql(f"SELECT event_id, CASE WHEN NOT isnan(v) AND v BETWEEN 0 AND 300 THEN round_even(v, 2) END AS value FROM (SELECT event_id, try_cast(trim({_raw}) AS DOUBLE) AS v FROM obs)", "obs"))
def p2(spark, sf_dir):
    return _raw_text(spark, sf_dir).select("event_id", P.number(F.col("raw"), 0, 300).alias("value"))


_c = "CASE WHEN {0} BETWEEN {1} AND {2} THEN round_even({0}, 2) END"


@query(
    "p3_cleaned_record",
    sql(f"""SELECT event_id, {_c.format("value * 4", 0, 1500)} AS pm25, {_c.format("value * 8", 0, 2500)} AS pm10, {_c.format("value - 20", 0, 1000)} AS nox, {_c.format("value / 3.1", -20, 60)} AS temperature,
    {_c.format("value", 0, 100)} AS humidity, {_c.format("value * 2", 0, 360)} AS wind_direction, {_c.format("value + 200", 200, 600)} AS brightness FROM obs""", "obs"),
)
def p3(spark, sf_dir):
    v = F.col("value")
    fields = {"pm25": (v * 4, 0, 1500), "pm10": (v * 8, 0, 2500), "nox": (v - 20, 0, 1000), "temperature": (v / 3.1, -20, 60), "humidity": (v, 0, 100), "wind_direction": (v * 2, 0, 360), "brightness": (v + 200, 200, 600)}
    return _obs(spark, sf_dir).select("event_id", *[P.number(x, lo, hi).alias(k) for k, (x, lo, hi) in fields.items()])


@query("p4_moment", sql("SELECT event_id, epoch_ms(date_trunc('second', ts))::BIGINT AS ms FROM obs", "obs"))
def p4(spark, sf_dir):
    e, s = F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = F.when(e % 3 == 0, s.cast("string")).when(e % 3 == 1, (s * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _obs(spark, sf_dir).select("event_id", F.unix_millis(P.moment(raw)).alias("ms"))


@query("p5_bulletin_number", sql(f"SELECT event_id, CASE WHEN v >= 0 THEN v END AS value FROM (SELECT event_id, try_cast(trim({_raw}) AS DOUBLE) AS v FROM obs) WHERE v IS NULL OR NOT isnan(v)", "obs"))
def p5(spark, sf_dir):
    return _raw_text(spark, sf_dir).where("raw <> 'nan'").select("event_id", P.bulletin_number(F.col("raw")).alias("value"))


@query("p6_bulletin_moment", sql("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END - INTERVAL 330 MINUTE AS at FROM obs", "obs"))
def p6(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.date_format("ts", "dd-MM-yyyy HH:mm:ss")).when(e % 3 == 1, F.date_format("ts", "dd-MM-yyyy HH:mm")).otherwise("soon")
    return _obs(spark, sf_dir).select("event_id", P.bulletin_moment(raw).cast("timestamp_ntz").alias("at"))


@query("p7_detected_at", sql("SELECT okey, line, CASE WHEN line <> 5 THEN strptime(acq_date || ' ' || CASE WHEN line = 6 THEN '0000' ELSE lpad(acq_time, 4, '0') END, '%Y-%m-%d %H%M') END AS at FROM px", "px"))
def p7(spark, sf_dir):
    line = F.col("line")
    t = F.when(line == 6, "noon").when(line == 1, F.concat("acq_time", F.lit(".0"))).otherwise(F.col("acq_time"))
    return pixels(spark, sf_dir).select("okey", "line", P.detected_at(F.when(line != 5, F.col("acq_date")), t).cast("timestamp_ntz").alias("at"))


@query("p8_wind_parts", sql("SELECT event_id, round(-value * sin(radians(event_id % 360)), 6) + 0.0 AS u, round(-value * cos(radians(event_id % 360)), 6) + 0.0 AS v, round(value / 3.6::DOUBLE, 6) AS ms FROM obs", "obs"))
def p8(spark, sf_dir):
    u, v = G.wind_parts(F.col("value"), F.col("event_id") % 360)
    return _obs(spark, sf_dir).select("event_id", (F.round(u, 6) + 0.0).alias("u"), (F.round(v, 6) + 0.0).alias("v"), F.round(W.kmh_to_ms(F.col("value")), 6).alias("ms"))


@query("p10_pbl_floor", sql("SELECT event_id, greatest(50.0::DOUBLE, value) AS archive, CASE WHEN value > 50 THEN value END AS live FROM obs", "obs"))
def p10(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", W.pbl_archive(F.col("value")).alias("archive"), W.pbl_live(F.col("value")).alias("live"))


@query("p11_channels", sql("SELECT event_id, round(least(1.0::DOUBLE, value / 1000), 9) AS pm25, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - 30 + 10) / 60)), 9) AS temperature, round(least(1.0::DOUBLE, value / 120), 9) AS o3_old FROM obs", "obs"))
def p11(spark, sf_dir):
    v = F.col("value")
    return _obs(spark, sf_dir).select("event_id", F.round(W.normalised(v, "pm25"), 9).alias("pm25"), F.round(W.normalised(v - 30, "temperature"), 9).alias("temperature"), F.round(W.normalised(v, "o3", legacy=True), 9).alias("o3_old"))


@query("p12_filters", "SELECT event_id, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type ILIKE '%I%' AND value BETWEEN 10 AND 90")
def p12(spark, sf_dir):
    d = read(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-12'")
    return d.where(F.col("event_type").ilike("%I%") & F.col("value").between(10, 90)).select("event_id", "user_id", "event_type", "value")


@query("p13_allow_list", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'o3' WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' END AS pollutant FROM events WHERE event_type IN ('signup', 'view', 'click')")
def p13(spark, sf_dir):
    names = F.create_map(*map(F.lit, ["signup", "o3", "view", "pm25", "click", "pm10"]))
    return read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view", "click")).select("event_id", names[F.col("event_type")].alias("pollutant"))


_pk = "sqrt(pow((lat - 28.6289) * 111, 2) + pow((lon - 77.2065) * 97.5, 2))"


@query(
    "p14_zone",
    sql(f"""SELECT id, CASE WHEN NOT (lat BETWEEN 28.4 AND 28.9 AND lon BETWEEN 76.84 AND 77.35) THEN 'NCR Outer' WHEN {_pk} <= 7 THEN 'Central' WHEN abs(lat - 28.6289) >= abs(lon - 77.2065) THEN CASE WHEN lat > 28.6289 THEN 'North' ELSE 'South' END WHEN lon > 77.2065 THEN 'East' ELSE 'West' END AS zone,
    CASE WHEN lat >= 28.7 THEN 'North' WHEN lat <= 28.5 THEN CASE WHEN lon BETWEEN 77.05 AND 77.35 THEN 'South' ELSE 'NCR Outer' END WHEN lon <= 77.05 THEN 'West' WHEN lon >= 77.3 THEN 'East' ELSE 'Central' END AS bulletin_zone FROM st""", "st"),
)
def p14(spark, sf_dir):
    return stations(spark, sf_dir).select("id", G.zone(F.col("lat"), F.col("lon")).alias("zone"), G.bulletin_zone(F.col("lat"), F.col("lon")).alias("bulletin_zone"))


BAND_SQL = "CASE WHEN lat >= 30.5 THEN 'upper corridor' WHEN lat >= 29.5 THEN 'mid corridor' WHEN lat >= 28.92 THEN 'lower corridor' WHEN lat >= 28.2 THEN 'NCR domain' ELSE 'south of NCR' END"
STATE_SQL = "CASE WHEN lat BETWEEN 28.2 AND 28.92 AND lon BETWEEN 76.8 AND 77.62 THEN 'Delhi NCR' WHEN lat >= 31.1 THEN 'Punjab / Himachal foothills' WHEN lat >= 29.6 AND lon <= 76.6 THEN 'Punjab' WHEN lat >= 29.6 THEN 'Haryana / Chandigarh' WHEN lon >= 77.3 THEN 'Western UP' WHEN lat < 28.6 AND lon < 76.2 THEN 'Northern Rajasthan' ELSE 'Haryana' END"
_region = "CASE WHEN lat BETWEEN 29.5 AND 32.5 AND lon BETWEEN 74 AND 76.8 THEN 'Punjab' WHEN lat BETWEEN 27.5 AND 30.8 AND lon BETWEEN 75.8 AND 77.8 THEN 'Haryana' WHEN lat BETWEEN 26.5 AND 30.5 AND lon BETWEEN 77.5 AND 80.5 THEN 'Western UP' WHEN lat BETWEEN 28.3 AND 28.9 AND lon BETWEEN 76.8 AND 77.5 THEN 'Delhi NCR' ELSE 'Surrounding Buffer' END"


@query("p16_fire_regions", sql(f"SELECT okey, line, {BAND_SQL} AS band, {STATE_SQL} AS state, {_region} AS ingest_region FROM px", "px"))
def p16(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return pixels(spark, sf_dir).select("okey", "line", G.latitude_band(lat).alias("band"), G.rough_state(lat, lon).alias("state"), G.ingest_region(lat, lon).alias("ingest_region"))


@query("p18_names", sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'DPCC' WHEN id % 3 = 1 THEN 'CPCB' ELSE upper(provider) END AS agency, split_part(name, ',', 1) AS display_name, split_part(name, ',', 1) AS short_name FROM st", "st"))
def p18(spark, sf_dir):
    n = F.col("name")
    return stations(spark, sf_dir).select("id", P.agency(n, F.col("provider")).alias("agency"), P.display_name(n).alias("display_name"), P.short_name(n).alias("short_name"))


@query("p19_fire_types", sql("SELECT CASE kind WHEN 0 THEN 'vegetation' WHEN 1 THEN 'volcano' WHEN 2 THEN 'other static land' WHEN 3 THEN 'offshore' ELSE 'unclassified' END AS kind, count(*) AS n FROM px GROUP BY 1", "px"))
def p19(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy(P.fire_type(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))


@query("p20_season_hint", "SELECT l_orderkey AS okey, l_linenumber AS line, CASE WHEN month(l_shipdate) = 11 OR (month(l_shipdate) = 10 AND day(l_shipdate) >= 10) THEN 'burning season' ELSE 'outside the burning season' END AS hint FROM lineitem")
def p20(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), P.season_hint(F.col("l_shipdate")).alias("hint"))


@query("p21_clamp", sql("SELECT okey, line, greatest(28.2::DOUBLE, least(28.9::DOUBLE, lat)) AS lat, greatest(76.8::DOUBLE, least(77.6::DOUBLE, lon)) AS lon FROM px", "px"))
def p21(spark, sf_dir):
    return pixels(spark, sf_dir).select("okey", "line", P.clamp(F.col("lat"), 28.2, 28.9).alias("lat"), P.clamp(F.col("lon"), 76.8, 77.6).alias("lon"))


@query("p22_redacted", "SELECT s_suppkey AS id, 'GET /x?api-key=REDACTED&b=2 token=REDACTED' AS line FROM supplier")
def p22(spark, sf_dir):
    text = F.concat(F.lit("GET /x?api-key=k"), F.col("s_suppkey"), F.lit("&b=2 token=t"), F.col("s_suppkey"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), P.redacted(text).alias("line"))


@query("p23_humidity", sql("SELECT event_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * exp(17.67 * (d - 273.15) / (d - 273.15 + 243.5)) / exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5)))), 6) AS rh FROM (SELECT event_id, 280 + value / 20 AS t, 278 + event_id % 20 AS d FROM obs)", "obs"))
def p23(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", F.round(W.humidity(280 + F.col("value") / 20, 278 + F.col("event_id") % 20), 6).alias("rh"))


@query("p24_decay", sql("SELECT event_id, round(CASE WHEN h < 0 THEN 0 WHEN h <= 2 THEN value WHEN h <= 6 THEN value * (1 - (h - 2) / 4) ELSE 0 END, 9) AS frp FROM (SELECT event_id, value, event_id % 90 / 10.0::DOUBLE - 1 AS h FROM obs)", "obs"))
def p24(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", F.round(W.decayed(F.col("value"), F.col("event_id") % 90 / F.lit(10.0) - 1), 9).alias("frp"))


@query("p25_ensure_columns", "SELECT s_suppkey AS id, s_acctbal AS value, NULL::VARCHAR AS daynight, NULL::DOUBLE AS kind FROM supplier")
def p25(spark, sf_dir):
    wanted = spark.createDataFrame([], "id long, value double, daynight string, kind double")
    return wanted.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), allowMissingColumns=True)


def _utm_sql() -> str:
    """Easting and northing by the same series, as nested table expressions over st."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    atanh = lambda x: f"(ln((1 + {x}) / (1 - {x})) / 2)"
    sinh, cosh = (lambda x, s=s: f"((exp({x}) {s} exp(-({x}))) / 2)" for s in "-+")
    sums = lambda f, g: " + ".join(f"{a!r}::DOUBLE * {f}({2 * j} * xi) * {g(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1))
    return f""", r AS (SELECT id, radians(lat) AS p, radians(lon - 75.0) AS dl FROM st),
    t AS (SELECT id, dl, {sinh(f"{atanh('sin(p)')} - {e!r}::DOUBLE * {atanh(f'({e!r}::DOUBLE * sin(p))')}")} AS t FROM r),
    x AS (SELECT id, atan2(t, cos(dl)) AS xi, {atanh("(sin(dl) / sqrt(1 + t * t))")} AS eta FROM t)
    SELECT id, round((eta + {sums("cos", sinh)}) * {scale!r}::DOUBLE + 500000, 3) AS easting, round((xi + {sums("sin", cosh)}) * {scale!r}::DOUBLE, 3) AS northing FROM x"""


@query("p26_utm", sql(_utm_sql(), "st"))
def p26(spark, sf_dir):
    e, n = G.utm(F.col("lat"), F.col("lon"))
    return stations(spark, sf_dir).select("id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("p27_columnar_records", sql(", a AS (SELECT list(lat ORDER BY okey, line) AS lat, list(lon ORDER BY okey, line) AS lon, list(frp ORDER BY okey, line) AS frp, satellite FROM px GROUP BY satellite) SELECT satellite, unnest(lat) AS lat, unnest(lon) AS lon, unnest(frp) AS frp FROM a", "px"))
def p27(spark, sf_dir):
    """Records as parallel arrays, a payload for each satellite and range of orders: as many as the table needs."""
    record = F.struct("okey", "line", "lat", "lon", "frp")
    part = F.floor(F.col("okey") / 2048).alias("part")
    rows = pixels(spark, sf_dir).groupBy("satellite", part).agg(F.sort_array(F.collect_list(record)).alias("r"))
    payload = rows.select("satellite", *[F.col(f"r.{c}").alias(c) for c in ("lat", "lon", "frp")])  # an array each
    return payload.select("satellite", F.inline(F.arrays_zip("lat", "lon", "frp")))
