"""Queries of sources, sinks, cards, scenarios and fields, each beside its SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import index as X
from ..functions import tables as T
from ..operators import fields as FL
from ..operators import scenario as SC
from ..operators import spatial as SP
from ..operators import store as ST
from ..sources.bridge import SMALL, observations, pixels, read, sql, stations, steady, steady_sql
from ..sources.scratch import scratch, written
from .expressions import CATEGORY_SQL, index_by_sql
from .geography import GRID_SQL
from .registry import Registry
from .relations import M_LAST, indexed
from .series import A2_SQL, h_small, hp
from .tools import ask

REG = Registry()
query = REG.query
K = ["station_id"]


@query("s1_partitioned_scan", sql("SELECT station_id, count(*) AS n, max(value) AS top FROM obs WHERE parameter = 'pm25' AND ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY station_id", "obs"))
def s1(spark, sf_dir):
    """A Hive-style folder by day and pollutant: both filters prune partitions."""
    path = scratch(spark, "observations")
    observations(spark, sf_dir, SMALL).withColumn("day", F.col("ts").cast("date")).write.partitionBy("day", "parameter").parquet(path)
    got = spark.read.parquet(path).where("parameter = 'pm25' and day between date'2024-01-10' and date'2024-01-12'")
    return got.groupBy("station_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("s3_csv_scan", "SELECT event_id, ts, value FROM events WHERE value > 20")
def s3(spark, sf_dir):
    path = scratch(spark, "events-csv")
    read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "value").write.option("header", True).csv(path)
    return spark.read.schema("event_id long, ts timestamp_ntz, value double").option("header", True).csv(path).where("value > 20")


@query("s5_archive_fallback", sql("SELECT okey, line, frp, 'standard' AS product FROM px WHERE acq_date < '1996-01-01' AND line > 2", "px"))
def s5(spark, sf_dir):
    """The preferred product is empty for the window, so the other one answers."""
    p = pixels(spark, sf_dir).where("acq_date < '1996-01-01'")
    swift = p.where("line > 99").select("okey", "line", "frp", F.lit("swift").alias("product"))
    return ST.preferred([swift, p.where("line > 2").select("okey", "line", "frp", F.lit("standard").alias("product"))], 1)


@query("s6_nested_catalogue", "SELECT n_nationkey AS station, s_suppkey AS sensor, CASE s_suppkey % 3 WHEN 0 THEN 'pm25' WHEN 1 THEN 'no2' ELSE 'o3' END AS parameter FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 7 <> 0")
def s6(spark, sf_dir):
    """Stations as JSON files with a map of sensor lists, a document for a thousand sensors; those without coordinates are
    skipped."""
    path = scratch(spark, "catalogue-json")
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    p = F.when(F.col("s_suppkey") % 3 == 0, "pm25").when(F.col("s_suppkey") % 3 == 1, "no2").otherwise("o3")
    part = F.floor(F.col("s_suppkey") / 1000).alias("part")
    one = s.groupBy("s_nationkey", part, p.alias("p")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("sensor_id"))).alias("l"))
    sensors = F.map_from_entries(F.collect_list(F.struct("p", "l"))).alias("sensors")
    docs = one.groupBy("s_nationkey", "part").agg(sensors).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    lat = F.when(F.col("n_nationkey") % 7 != 0, F.lit(28.5))
    docs.select(F.col("n_nationkey").alias("location_id"), lat.alias("latitude"), "sensors").write.json(path)
    schema = "location_id int, latitude double, sensors map<string, array<struct<sensor_id: bigint>>>"
    back = spark.read.schema(schema).json(path).where("latitude is not null")
    lists = back.select(F.col("location_id").alias("station"), F.explode("sensors").alias("parameter", "l"))
    return lists.select("station", F.explode("l").alias("x"), "parameter").select("station", F.col("x.sensor_id").alias("sensor"), "parameter")


@query("s15_latest_measurements", sql("SELECT station_id, max(value) FILTER (parameter = 'pm25') AS pm25, coalesce(nullif(max(value) FILTER (parameter = 'no2'), 0), max(value) FILTER (parameter = 'so2')) AS nox, max(value) FILTER (parameter = 'o3') AS o3 FROM hp WHERE hour = (SELECT max(hour) FROM hp) GROUP BY station_id", "hp"))
def s15(spark, sf_dir):
    h = hp(spark, sf_dir, SMALL)
    now = h.join(F.broadcast(h.agg(F.max("hour").alias("hour"))), "hour")  # one row
    m = now.groupBy("station_id").agg(F.map_from_entries(F.collect_list(F.struct("parameter", "value"))).alias("m"))  # one entry a pollutant
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("station_id", get("pm25").alias("pm25"), F.coalesce(F.nullif(get("no2"), F.lit(0.0)), get("so2")).alias("nox"), get("o3").alias("o3"))


@query("s16_weather_surrogate", sql("SELECT event_id, coalesce(CASE WHEN event_id % 4 > 0 THEN value * 10 END, 350 + 800 * greatest(0.0::DOUBLE, 1 - pow(extract(hour FROM ts) - 8, 2) / 36)) AS pbl FROM obs", "obs"))
def s16(spark, sf_dir):
    h = F.hour("ts")
    o = observations(spark, sf_dir, SMALL)
    return o.select("event_id", F.coalesce(F.when(F.col("event_id") % 4 > 0, F.col("value") * 10), 350 + 800 * F.greatest(F.lit(0.0), 1 - F.pow(h - 8, F.lit(2)) / 36)).alias("pbl"))


@query("s17_brightness", sql("SELECT okey, line, coalesce(CASE WHEN line % 3 = 0 THEN 300 + frp END, CASE WHEN line % 3 = 1 THEN 310 + frp END, 320) AS brightness FROM px", "px"))
def s17(spark, sf_dir):
    f, n = F.col("frp"), F.col("line") % 3
    return pixels(spark, sf_dir).select("okey", "line", F.coalesce(F.when(n == 0, 300 + f), F.when(n == 1, 310 + f), F.lit(320.0)).alias("brightness"))


@query("s18_units_per_sensor", sql("SELECT sensor_id % 3 = 2 AS skipped, count(*) AS n FROM obs GROUP BY 1", "obs"))
def s18(spark, sf_dir):
    o = observations(spark, sf_dir, SMALL)
    units = o.select("sensor_id").distinct().where("sensor_id % 3 <> 2").select("sensor_id", F.lit("ug/m3").alias("unit"))
    return o.join(units, "sensor_id", "left").groupBy(F.col("unit").isNull().alias("skipped")).agg(F.count("*").alias("n"))


@query("k1_index_by_season", sql(f"{A2_SQL} SELECT extract(day FROM hour) // 8 AS season, count(*) AS n, count(*) FILTER (valid) AS valid FROM mesh GROUP BY 1", "hp_large"))
def k1(spark, sf_dir):
    from .series import mesh

    path = scratch(spark, "index")
    mesh(spark, sf_dir).withColumn("season", F.floor(F.dayofmonth("hour") / 8)).write.partitionBy("season").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


@query("k9_score_report", "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def k9(spark, sf_dir):
    path = scratch(spark, "report")
    read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).write.option("header", True).csv(path)
    return spark.read.schema("status string, n long, top double").option("header", True).csv(path)


def subs(spark, sf_dir) -> DataFrame:
    h = hp(spark, sf_dir, SMALL)
    now = h.join(F.broadcast(h.agg(F.max("hour").alias("hour"))), "hour")
    return now.withColumn("sub", X.by_pollutant(F.col("parameter"), lambda p: X.sub_index(p, F.col("value"))))


SUBS = f"subs AS (SELECT *, {index_by_sql('parameter', 'value')} AS sub FROM hp WHERE hour = (SELECT max(hour) FROM hp))"
_pols = "(VALUES ('pm25'), ('pm10'), ('no2'), ('so2'), ('o3'), ('co'), ('nh3')) p(parameter)"


@query("x26_pollutant_cards", sql(f", {SUBS}, s AS (SELECT DISTINCT station_id FROM hp) SELECT s.station_id, p.parameter, sub IS NOT NULL AS measured, CASE WHEN sub IS NOT NULL THEN greatest(2, least(100, sub)) END AS pct, {CATEGORY_SQL.format('sub')} AS status FROM s CROSS JOIN {_pols} LEFT JOIN subs ON subs.station_id = s.station_id AND subs.parameter = p.parameter", "hp"))
def x26(spark, sf_dir):
    every = hp(spark, sf_dir, SMALL).select("station_id").distinct().withColumn("parameter", F.explode(F.array(*map(F.lit, ["pm25", "pm10", "no2", "so2", "o3", "co", "nh3"]))))
    c = every.join(subs(spark, sf_dir).select("station_id", "parameter", "sub"), ["station_id", "parameter"], "left")
    return c.select("station_id", "parameter", F.col("sub").isNotNull().alias("measured"), F.when(F.col("sub").isNotNull(), F.greatest(F.lit(2), F.least(F.lit(100), F.col("sub")))).alias("pct"), X.category(F.col("sub")).alias("status"))


@query("x27_source_attribution", sql(", d AS (SELECT acq_date, count(*) FILTER (line < 5) AS fires, CASE WHEN min(okey) % 5 > 0 THEN round(sum(frp) FILTER (line < 5) / 10, 6) END AS share FROM px GROUP BY acq_date) SELECT acq_date, fires, CASE WHEN fires = 0 THEN 0 WHEN share IS NOT NULL THEN floor(share * 10 + 0.5) / 10 END AS share, CASE WHEN fires = 0 OR share IS NOT NULL THEN 'measured' ELSE 'no fire data' END AS note FROM d", "px"))
def x27(spark, sf_dir):
    """A reported zero is a measurement; a missing share is none."""
    small = F.col("line") < 5
    d = pixels(spark, sf_dir).groupBy("acq_date").agg(F.count_if(small).alias("fires"), F.when(F.min("okey") % 5 > 0, F.round(F.sum(F.when(small, F.col("frp"))) / 10, 6)).alias("share"))
    zero = F.col("fires") == 0
    return d.select("acq_date", "fires", F.when(zero, 0.0).when(F.col("share").isNotNull(), SC.rounded(F.col("share"), 1)).alias("share"), F.when(zero | F.col("share").isNotNull(), "measured").otherwise("no fire data").alias("note"))


@query("a35_channel_states", sql(f", {SUBS} SELECT p.parameter, CASE WHEN p.parameter IN (SELECT parameter FROM subs WHERE sub IS NOT NULL) THEN 'indexed' WHEN p.parameter = 'co' THEN 'withheld' ELSE 'absent' END AS state FROM {_pols}", "hp"))
def a35(spark, sf_dir):
    order = spark.createDataFrame([(p,) for p in ("pm25", "pm10", "no2", "so2", "o3", "co", "nh3")], "parameter string")
    held = spark.createDataFrame([("co", True)], "parameter string, withheld boolean")
    there = subs(spark, sf_dir).where("sub is not null").select("parameter", F.lit(True).alias("there")).distinct()
    c = order.join(there, "parameter", "left").join(F.broadcast(held), "parameter", "left")
    return c.select("parameter", F.when(F.col("there"), "indexed").when(F.col("withheld"), "withheld").otherwise("absent").alias("state"))


@query("a40_mesh_range", sql(f"{A2_SQL}, {M_LAST} SELECT zone, min(aqi) AS low, max(aqi) AS high, count(*) AS n FROM ml GROUP BY zone", "hp_large"))
def a40(spark, sf_dir):
    return indexed(spark, sf_dir).groupBy("zone").agg(F.min("aqi").alias("low"), F.max("aqi").alias("high"), F.count("*").alias("n"))


@query("a45_index_of_means", sql(f", {SUBS} SELECT station_id, count(sub) AS n, CASE WHEN count(sub) >= 3 THEN max(sub) END AS aqi FROM subs GROUP BY station_id", "hp"))
def a45(spark, sf_dir):
    """From averages as they are, without a window: three sub-indices suffice, whichever they are."""
    return subs(spark, sf_dir).groupBy("station_id").agg(F.count("sub").alias("n"), F.max("sub").alias("m")).select("station_id", "n", F.when(F.col("n") >= 3, F.col("m")).alias("aqi"))


@query("a47_kpi_cards", sql(f", {SUBS} SELECT parameter, CASE WHEN avg(CASE WHEN parameter <> 'o3' THEN value END) IS NOT NULL THEN 'ug/m3' ELSE 'sub-index' END AS unit, {steady_sql("coalesce(avg(CASE WHEN parameter <> 'o3' THEN value END), avg(sub))")} AS value, count(*) AS live FROM subs GROUP BY parameter", "hp"))
def a47(spark, sf_dir):
    conc = F.avg(F.when(F.col("parameter") != "o3", F.col("value")))
    s = subs(spark, sf_dir).groupBy("parameter").agg(conc.alias("c"), F.avg("sub").alias("i"), F.count("*").alias("live"))
    return s.select("parameter", F.when(F.col("c").isNotNull(), "ug/m3").otherwise("sub-index").alias("unit"), steady(F.coalesce("c", "i")).alias("value"), "live")


@query("a48_regime_scale", sql(f"SELECT {steady_sql('avg(value) / 111', 9)} AS regime FROM h_small WHERE hour = (SELECT min(hour) FROM h_small)", "h_small"))
def a48(spark, sf_dir):
    h = h_small(spark, sf_dir)
    return h.join(F.broadcast(h.agg(F.min("hour").alias("hour"))), "hour").agg(steady(F.avg("value") / 111, 9).alias("regime"))


@query("a51_physical_error", sql(f"SELECT station_id, {steady_sql('sqrt(avg(pow(least(1.0::DOUBLE, value / 1000) * 1000 - 40, 2)))')} AS rmse FROM h_small GROUP BY station_id", "h_small"))
def a51(spark, sf_dir):
    from ..functions import weather as W

    e = W.physical(W.normalised(F.col("value"), "pm25"), "pm25") - 40
    return h_small(spark, sf_dir).groupBy("station_id").agg(steady(F.sqrt(F.avg(e * e))).alias("rmse"))


@query("t7_shortfall_rank", sql("SELECT parameter, 8 - count(DISTINCT station_id) AS missing, rank() OVER (ORDER BY 8 - count(DISTINCT station_id) DESC, parameter)::INTEGER AS place FROM hp WHERE hour = (SELECT max(hour) FROM hp) GROUP BY parameter", "hp"))
def t7(spark, sf_dir):
    from pyspark.sql import Window

    c = subs(spark, sf_dir).groupBy("parameter").agg((8 - F.countDistinct("station_id")).alias("missing"))
    return c.withColumn("place", F.rank().over(Window.orderBy(F.desc("missing"), "parameter")))  # a row a pollutant


@query("t10_hub_station", sql(f", {SUBS}, m AS (SELECT station_id, max(sub) AS aqi FROM subs GROUP BY station_id) SELECT station_id, aqi FROM m ORDER BY station_id <> 77, station_id <> 5, aqi DESC, station_id LIMIT 1", "hp"))
def t10(spark, sf_dir):
    m = subs(spark, sf_dir).groupBy("station_id").agg(F.max("sub").alias("aqi"))
    return m.orderBy(F.col("station_id") != 77, F.col("station_id") != 5, F.desc("aqi"), "station_id").limit(1)


@query("t11_worst_first", sql(f", {SUBS} SELECT station_id, parameter, sub FROM subs WHERE sub IS NOT NULL ORDER BY sub DESC, station_id, parameter LIMIT 10", "hp"))
def t11(spark, sf_dir):
    return subs(spark, sf_dir).where("sub is not null").orderBy(F.desc("sub"), "station_id", "parameter").limit(10).select("station_id", "parameter", "sub")


@query("o7_engine_fallback", sql("SELECT station_id, hour, CASE WHEN station_id % 3 = 0 THEN 40 ELSE value END AS value, station_id % 3 = 0 AS is_synthetic FROM h_small", "h_small"))
def o7(spark, sf_dir):
    h = h_small(spark, sf_dir)
    there = h.where("station_id % 3 <> 0").select("station_id", "hour", F.col("value").alias("v"))
    j = h.select("station_id", "hour").join(there, ["station_id", "hour"], "left")
    return j.select("station_id", "hour", F.coalesce("v", F.lit(40.0)).alias("value"), F.col("v").isNull().alias("is_synthetic"))


_NEAR = "CASE WHEN km = 0 THEN 1e-26 ELSE km * km END"
G2_SQL = f"""{GRID_SQL}, kk AS (SELECT gy, gx, id, km, row_number() OVER (PARTITION BY gy, gx ORDER BY km, id) AS rank
      FROM (SELECT gy, gx, id, sqrt(pow((lat - glat) * 111.0::DOUBLE, 2) + pow((lon - glon) * 97.5::DOUBLE, 2)) AS km
      FROM g, st WHERE id IN (SELECT station_id FROM h_small))),
    lastv AS (SELECT station_id AS id, arg_max(value, hour) AS value FROM h_small GROUP BY 1),
    g2 AS MATERIALIZED (SELECT gy, gx, round(sum(value / ({_NEAR})) / sum(1 / ({_NEAR})), 6) AS value
      FROM kk JOIN lastv USING (id) WHERE rank <= 8 GROUP BY gy, gx)"""


@query("g2_filled_grid", sql(f", {G2_SQL} SELECT gy, gx, value FROM g2", "st", "h_small"))
def g2(spark, sf_dir):
    """Silent stations are filled forward first, so every one of a cell's eight counts."""
    h = h_small(spark, sf_dir)
    last = h.groupBy(F.col("station_id").alias("id")).agg(F.max(F.struct("hour", "value"))["value"].alias("value"))
    w = SP.nearest_stations(SP.grid(spark), stations(spark, sf_dir).join(last, "id", "left_semi"))
    f = SP.weighted(w, last, ["gy", "gx"])
    return f.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round("value", 6).alias("value"))


@query("g4_spline_field")
def g4(spark, sf_dir):
    """A field for each hour of the table, through all stations that report in it."""
    v = h_small(spark, sf_dir).withColumnRenamed("station_id", "id").join(stations(spark, sf_dir).select("id", "lat", "lon"), "id")
    cells = [(i, j, 28.2 + i * 0.7 / 9, 76.8 + j * 0.8 / 9) for i in range(10) for j in range(10)]
    return FL.spline(v, cells)


@query("g6_fire_transport", sql(f""", a AS (SELECT okey, line, frp, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(28.55 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(28.55)) * pow(sin(radians(77.2 - lon) / 2), 2))) AS km,
    cos(atan2(sin(radians(77.2 - lon)) * cos(radians(28.55)), cos(radians(lat)) * sin(radians(28.55)) - sin(radians(lat)) * cos(radians(28.55)) * cos(radians(77.2 - lon))) - atan2(3.0::DOUBLE, -4.0::DOUBLE)) AS al FROM px)
    SELECT okey, line, round(CASE WHEN al > 0.3 THEN km / (18 * al + 1e-6) END, 6) AS arrival_h, round(frp * greatest(al, 0.0::DOUBLE) * exp(-0.5 * pow(km / 80, 2)), 6) AS proxy FROM a""", "px"))  # fmt: skip
def g6(spark, sf_dir):
    from ..functions import geo as G

    lat, lon = F.col("lat"), F.col("lon")
    align = F.cos(F.radians(G.bearing_deg(lat, lon, 28.55, 77.2)) - F.atan2(F.lit(3.0), F.lit(-4.0)))
    km = G.haversine_km(lat, lon, 28.55, 77.2)
    return pixels(spark, sf_dir).select("okey", "line", F.round(F.when(align > 0.3, km / (align * 18 + 1e-6)), 6).alias("arrival_h"), F.round(F.col("frp") * F.greatest(align, F.lit(0.0)) * F.exp(F.pow(km / 80, F.lit(2)) * -0.5), 6).alias("proxy"))


@query("g8_channel_stack", sql("SELECT hour, " + ", ".join(f"{steady_sql(f'''avg(value) FILTER (parameter = '{p}')''')} AS {p}" for p in T.POLLUTANTS) + " FROM hp GROUP BY hour", "hp"))
def g8(spark, sf_dir):
    p = hp(spark, sf_dir, SMALL).groupBy("hour").pivot("parameter", T.POLLUTANTS).agg(F.avg("value"))
    return p.select("hour", *[steady(F.col(c)).alias(c) for c in T.POLLUTANTS])


#: Levels of the contour lines of a filled field, and the one whose segments are held against SQL.
LEVELS, LEVEL = (10.0, 20.0, 30.0, 50.0), 50.0
# --- fixed values: which edges the strands of a cell join, by which of its corners reach the level ---
_LINES = {1: "lb", 2: "br", 3: "lr", 4: "tr", 6: "tb", 7: "lt", 8: "lt", 9: "tb", 11: "tr", 12: "lr", 13: "br", 14: "lb"}
_EDGE = {
    "t": (f"x + ({LEVEL} - tl) / (tr - tl)", "y"),
    "r": ("x + 1", f"y + ({LEVEL} - tr) / (br - tr)"),
    "b": (f"x + ({LEVEL} - bl) / (br - bl)", "y + 1"),
    "l": ("x", f"y + ({LEVEL} - tl) / (bl - tl)"),
}


def _seg(*pairs: str) -> str:
    ends = [{"x1": _EDGE[a][0], "y1": _EDGE[a][1], "x2": _EDGE[b][0], "y2": _EDGE[b][1]} for a, b in pairs]
    return "[" + ", ".join("{" + ", ".join(f"'{k}': ({x})::DOUBLE" for k, x in end.items()) + "}" for end in ends) + "]"


_BITS = " + ".join(f"({c} >= {LEVEL})::INTEGER * {w}" for c, w in (("tl", 8), ("tr", 4), ("br", 2), ("bl", 1)))
_CASES = " ".join(f"WHEN k = {n} THEN {_seg(p)}" for n, p in _LINES.items())
G11_SQL = f""", {G2_SQL},
    c AS (SELECT a.gy AS y, a.gx AS x, a.value AS tl, b.value AS tr, d.value AS br, e.value AS bl FROM g2 a JOIN g2 b ON b.gy = a.gy AND b.gx = a.gx + 1
      JOIN g2 d ON d.gy = a.gy + 1 AND d.gx = a.gx + 1 JOIN g2 e ON e.gy = a.gy + 1 AND e.gx = a.gx),
    k AS (SELECT *, {_BITS} AS k, (tl + tr + br + bl) / 4 >= {LEVEL} AS j FROM c),
    s AS (SELECT y, x, CASE {_CASES} WHEN (k = 5) = j THEN {_seg("lt", "br")} ELSE {_seg("lb", "tr")} END AS s FROM k WHERE k NOT IN (0, 15)),
    u AS (SELECT y, x, unnest(range(len(s))) AS segment, unnest(s) AS e FROM s)
    SELECT y, x, segment::INTEGER AS segment, round(e.x1, 6) AS x1, round(e.y1, 6) AS y1, round(e.x2, 6) AS x2, round(e.y2, 6) AS y2
    FROM u WHERE abs(e.x1 - e.x2) > 1e-9 OR abs(e.y1 - e.y2) > 1e-9"""


@query("g11_contours", sql(G11_SQL, "st", "h_small"))
def g11(spark, sf_dir):
    """Where the filled field (g2) crosses a level."""
    return FL.contours(written(g2(spark, sf_dir), "field"), LEVEL).select("y", "x", "segment", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("g11_lines")
def g11_lines(spark, sf_dir):
    """Smooth lines of the filled field (g2) at its levels."""
    field = written(g2(spark, sf_dir), "field")
    segments = [FL.contours(field, level).withColumn("level", F.lit(level)) for level in LEVELS]
    return FL.polylines(reduce(DataFrame.unionByName, segments), ["level"])


# The wind of a station: its last value stands for mixing height (8 m a unit), speed (1/25) and bearing (7 degrees).
_WINDS = "lv AS (SELECT station_id AS id, arg_max(value, hour) AS value FROM h_small GROUP BY 1), ws AS (SELECT lat, lon, value, radians(value * 7 % 360 + 180) AS toward FROM st JOIN lv USING (id)), air AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - avg(value * 8) / 900)) AS stag, avg(value / 25) AS mean FROM ws)"


def _ridge_sql(before: str, name: str, alat: float, alon: float, blat: float, blon: float, width: float) -> str:
    """One ridge's turn of the flow as two table expressions after ``before``."""
    k = FL.LON_SCALE
    ax, ay, dx, dy = alon * k, alat, (blon - alon) * k, blat - alat
    size = math.hypot(dx, dy)
    tx, ty = dx / size, dy / size
    d = lambda x: f"({x!r}::DOUBLE)"
    along = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((lon * {d(k)} - {d(ax)}) * {d(tx)} + (lat - {d(ay)}) * {d(ty)}) / {d(size)}))"
    off = f"pow(lon * {d(k)} - (al * {d(dx)} + {d(ax)}), 2) + pow(lat - (al * {d(dy)} + {d(ay)}), 2)"
    return f"""{name}a AS (SELECT *, {along} AS al FROM {before}), {name}b AS (SELECT * EXCLUDE (al), exp(-({off}) / {d(width * width)}) AS e FROM {name}a),
    {name} AS (SELECT * EXCLUDE (e, u, v, blocked), greatest(blocked, CASE WHEN e >= 0.01 THEN e ELSE 0 END) AS blocked, u + CASE WHEN e >= 0.01 THEN CASE WHEN u * {d(tx)} + v * {d(ty)} >= 0 THEN 1.15 ELSE -1.15 END * e * {d(tx)} ELSE 0 END AS u,
    v + CASE WHEN e >= 0.01 THEN CASE WHEN u * {d(tx)} + v * {d(ty)} >= 0 THEN 1.15 ELSE -1.15 END * e * {d(ty)} ELSE 0 END AS v FROM {name}b)"""


_G12 = f""", {_WINDS}, cells AS (SELECT gy, gx, 28.2::DOUBLE + gy * (0.7::DOUBLE / 23) AS lat, 76.8::DOUBLE + gx * (0.8::DOUBLE / 23) AS lon FROM range(24) a(gy), range(24) b(gx)),
    f AS (SELECT gy, gx, c.lat, c.lon, sum(sin(toward) / q) AS su, sum(cos(toward) / q) AS sv FROM (SELECT c.*, toward, greatest(1e-4::DOUBLE, pow(c.lat - w.lat, 2) + pow((c.lon - w.lon) * {FL.LON_SCALE!r}::DOUBLE, 2)) AS q FROM cells c, ws w) c GROUP BY ALL),
    r0 AS (SELECT gy, gx, lat, lon, su / sqrt(su * su + sv * sv) AS u, sv / sqrt(su * su + sv * sv) AS v, 0.0::DOUBLE AS blocked FROM f), {_ridge_sql("r0", "r1", *FL.RIDGES[0])}, {_ridge_sql("r1", "r2", *FL.RIDGES[1])},
    p AS (SELECT *, {FL.BASIN[0]}::DOUBLE - lat AS ny, ({FL.BASIN[1]}::DOUBLE - lon) * {FL.LON_SCALE!r}::DOUBLE AS nx FROM r2), q AS (SELECT *, greatest(1e-6::DOUBLE, sqrt(ny * ny + nx * nx)) AS dist FROM p),
    o AS (SELECT *, u + nx / dist * exp(-pow(dist / 0.34::DOUBLE, 2)) * stag * 1.25 AS uu, v + ny / dist * exp(-pow(dist / 0.34::DOUBLE, 2)) * stag * 1.25 AS vv, (1 - blocked * 0.4) * (1 - exp(-pow(dist / 0.3::DOUBLE, 2)) * stag * 0.45) * mean * (0.4 + 0.85 * (1 - stag)) AS speed FROM q, air)
    SELECT gy, gx, round(uu / sqrt(uu * uu + vv * vv) * speed, 6) AS u, round(vv / sqrt(uu * uu + vv * vv) * speed, 6) AS v, round(speed, 6) AS speed FROM o"""


@query("g12_terrain_wind", sql(_G12, "st", "h_small"))
def g12(spark, sf_dir):
    """The flow between all stations' winds over the terrain; how still and how fast the air is follows from their means."""
    last = h_small(spark, sf_dir).groupBy(F.col("station_id").alias("id")).agg(F.max(F.struct("hour", "value"))["value"].alias("value"))
    winds = stations(spark, sf_dir).join(last, "id").withColumn("from_deg", F.col("value") * 7 % 360)
    air = winds.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.avg(F.col("value") * 8) / 900)).alias("still"), F.avg(F.col("value") / 25).alias("mean"))
    cells = FL.flow(SP.grid(spark, 24, 24), winds).join(F.broadcast(air))  # one row
    u, v, s = FL.terrain_wind(F.col("lat"), F.col("lon"), F.col("u"), F.col("v"), F.col("still"), F.col("mean"))
    return cells.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(s, 6).alias("speed"))


@query("f7_frames", sql(f""", {SUBS}, m AS (SELECT station_id, max(sub) AS aqi FROM subs GROUP BY station_id), o AS (SELECT station_id, aqi, unnest(range(73)) AS f FROM m), s AS (SELECT *, aqi * ((1 + 0.32 * cos(((7 + f) % 24 - 7) / 24.0::DOUBLE * 2 * pi())) / (1 + 0.32 * cos((7 - 7) / 24.0::DOUBLE * 2 * pi()))) * ((1 + 0.06 * sin(f * 0.7::DOUBLE + station_id * 1.3::DOUBLE)) / (1 + 0.06 * sin(station_id * 1.3::DOUBLE))) AS x FROM o)
    SELECT station_id, f::INTEGER AS lead, floor(x + 0.5)::INTEGER AS aqi FROM s""", "hp"))  # fmt: skip
def f7(spark, sf_dir):
    """Frames that leave hour 0 as measured: dial and jitter are relative to theirs at hour 0, here seven in the morning."""
    from ..functions.weather import diurnal

    m = subs(spark, sf_dir).groupBy("station_id").agg(F.max("sub").alias("aqi"))
    o = m.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(72))))
    jitter = lambda f: F.sin(f * 0.7 + F.col("station_id") * 1.3) * 0.06 + 1
    shape = diurnal((F.col("lead") + 7) % 24) / diurnal(F.lit(7.0)) * (jitter(F.col("lead")) / jitter(F.lit(0.0)))
    return o.select("station_id", "lead", X.half_up(F.col("aqi") * shape).alias("aqi"))


@query("u2_named_tool", sql(f"{A2_SQL}, {M_LAST} SELECT max(aqi) AS worst, {steady_sql('avg(aqi)')} AS mean FROM ml", "hp_large"))
def u2(spark, sf_dir):
    return ask(spark, sf_dir, "city_now")
