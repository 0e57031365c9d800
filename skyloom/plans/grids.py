"""Queries of gridded channels, physical losses and streamlines, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import cube as C
from ..operators import fields as FL
from ..operators import spatial as SP
from ..operators.streamlines import streamlines
from ..sources.bridge import SMALL, pixels, sql, stations, steady, steady_sql
from ..sources.scratch import written
from .registry import Registry
from .series import h_small, hp

REG = Registry()
query = REG.query
#: Lines of the grid of the cube, both ways.
SIDE = 12
g = T.GRID
_STEP = ((g["north"] - g["south"]) / (SIDE - 1), (g["east"] - g["west"]) / (SIDE - 1))
_NAMED = {"pm25": "pm25", "pm10": "pm10", "o3": "o3", "no2": "nox"}


def weather(x, hour) -> dict:
    """What stands for the weather at a station: expressions of its hourly value and of the hour."""
    sun = F.greatest(F.lit(0.0), F.sin((F.hour(hour) - 6) * (math.pi / 12)))
    return {
        "u_wind": x / 250 * F.sin(F.radians(x * 7)),
        "v_wind": x / 250 * F.cos(F.radians(x * 7)),
        "temp": x / 20 + 10,
        "rh": F.greatest(F.lit(0.0), 100 - x / 10),
        "solar_irr": sun * 700,
        "pbl": x * 4 + sun * 300,
    }


_SUN = "greatest(0.0::DOUBLE, sin((extract(hour FROM hour) - 6) * (pi() / 12)))"
_WEATHER_SQL = {
    "u_wind": "value / 250 * sin(radians(value * 7))",
    "v_wind": "value / 250 * cos(radians(value * 7))",
    "temp": "value / 20 + 10",
    "rh": "greatest(0.0::DOUBLE, 100 - value / 10)",
    "solar_irr": f"{_SUN} * 700",
    "pbl": f"value * 4 + {_SUN} * 300",
}


def cells(spark: SparkSession) -> DataFrame:
    return SP.grid(spark, SIDE, SIDE)


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, channel, gy, gx, value): pollutants by inverse distance over the reporting ones of a cell's eight stations,
    weather as the mean of a cell's own stations, fires as they spread over the grid, the same at each hour."""
    s = stations(spark, sf_dir)
    near = SP.nearest_stations(cells(spark), s)
    named = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])
    seen = hp(spark, sf_dir, SMALL).withColumn("channel", named[F.col("parameter")]).where("channel is not null").withColumnRenamed("station_id", "id")
    air = SP.weighted(near, seen, ["hour", "channel", "gy", "gx"])
    h = h_small(spark, sf_dir)
    y, x = (F.floor((F.col(c) - g[a]) / step + 0.5).cast("int") for c, a, step in (("lat", "south", _STEP[0]), ("lon", "west", _STEP[1])))
    there = h.join(s.select(F.col("id").alias("station_id"), y.alias("gy"), x.alias("gx")), "station_id")
    w = weather(F.col("value"), F.col("hour"))
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), e.alias("value")) for c, e in w.items()])
    met = there.select("hour", "gy", "gx", F.explode(pairs).alias("x")).select("hour", "x.channel", "gy", "gx", "x.value")
    plume = SP.plume(cells(spark), pixels(spark, sf_dir).select("lat", "lon", "frp"), 3.0, -4.0)
    burnt = plume.select("gy", "gx", F.explode(F.create_map(F.lit("frp"), "frp", F.lit("smoke"), "smoke")).alias("channel", "value"))
    hours = h.select("hour").distinct()
    fire = hours.join(F.broadcast(burnt)).select("hour", "channel", "gy", "gx", "value")  # two rows a cell of a fixed grid
    columns = ["hour", "channel", "gy", "gx", "value"]
    return air.select(*columns).unionByName(met.select(*columns)).unionByName(fire)


def the_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stack(gridded(spark, sf_dir), SIDE, SIDE)


_PLACES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(C.CHANNELS))
CUBE_SQL = f"""
    g AS MATERIALIZED (SELECT gy, gx, {g['south']}::DOUBLE + gy * {_STEP[0]!r}::DOUBLE AS glat, {g['west']}::DOUBLE + gx * {_STEP[1]!r}::DOUBLE AS glon
      FROM range({SIDE}) a(gy), range({SIDE}) b(gx)),
    kk AS (SELECT gy, gx, id, km, row_number() OVER (PARTITION BY gy, gx ORDER BY km, id) AS rank
      FROM (SELECT gy, gx, id, sqrt(pow((lat - glat) * 111.0::DOUBLE, 2) + pow((lon - glon) * 97.5::DOUBLE, 2)) AS km FROM g, st)),
    k8 AS MATERIALIZED (SELECT gy, gx, id, 1 / CASE WHEN km = 0 THEN 1e-26 ELSE km * km END AS w FROM kk WHERE rank <= 8),
    air AS (SELECT hour, CASE parameter WHEN 'no2' THEN 'nox' ELSE parameter END AS channel, gy, gx, sum(w * value) / sum(w) AS value
      FROM hp JOIN k8 ON hp.station_id = k8.id WHERE parameter IN ('pm25', 'pm10', 'o3', 'no2') GROUP BY ALL),
    spot AS (SELECT h_small.*, floor((lat - {g['south']}) / {_STEP[0]!r}::DOUBLE + 0.5)::BIGINT AS gy, floor((lon - {g['west']}) / {_STEP[1]!r}::DOUBLE + 0.5)::BIGINT AS gx
      FROM h_small JOIN st ON station_id = id),
    met AS (SELECT hour, channel, gy, gx, avg(v) AS value FROM (
      SELECT hour, gy, gx, unnest([{', '.join(f"'{c}'" for c in _WEATHER_SQL)}]) AS channel, unnest([{', '.join(_WEATHER_SQL.values())}]) AS v FROM spot)
      WHERE gy BETWEEN 0 AND {SIDE - 1} AND gx BETWEEN 0 AND {SIDE - 1} GROUP BY ALL),
    pp AS (SELECT gy, gx, frp, (glon - lon) * 97.5::DOUBLE AS dx, (glat - lat) * 111.0::DOUBLE AS dy FROM px, g),
    pa AS (SELECT *, dx * (3.0::DOUBLE / 5) + dy * (-4.0::DOUBLE / 5) AS al, abs(dy * (3.0::DOUBLE / 5) - dx * (-4.0::DOUBLE / 5)) AS ac FROM pp),
    fire AS MATERIALIZED (SELECT gy, gx, sum(frp * exp(-(dx * dx + dy * dy) / 4050)) * 0.22 AS frp,
      sum(CASE WHEN al > 0 AND al / 18 <= 72 THEN frp * exp(-(ac * ac) / 4050) / (1 + al / 200) * (2.0::DOUBLE / 5) ELSE 0 END) * 0.22 AS smoke FROM pa GROUP BY gy, gx),
    hours AS (SELECT DISTINCT hour FROM h_small),
    known AS MATERIALIZED (SELECT hour, channel, gy * {SIDE} + gx AS k, gy, gx, value FROM (SELECT * FROM air UNION ALL SELECT * FROM met
      UNION ALL SELECT hour, 'frp', gy, gx, frp FROM hours, fire UNION ALL SELECT hour, 'smoke', gy, gx, smoke FROM hours, fire)),
    rest AS (SELECT hour, channel, k, gy, gx FROM (SELECT DISTINCT hour, channel FROM known), (SELECT gy * {SIDE} + gx AS k, gy, gx FROM g)
      EXCEPT SELECT hour, channel, k, gy, gx FROM known),
    filled AS (SELECT r.hour, r.channel, r.k, arg_min(n.value, (pow(r.gy - n.gy, 2) + pow(r.gx - n.gx, 2)) * 1000 + n.k) AS value, true AS gap
      FROM rest r JOIN known n USING (hour, channel) GROUP BY r.hour, r.channel, r.k),
    whole AS (SELECT hour, channel, k, value, false AS gap FROM known UNION ALL SELECT * FROM filled),
    cube AS MATERIALIZED (SELECT hour, channel, place, k, coalesce(value, 0) AS value, coalesce(gap, false) AS gap
      FROM (SELECT * FROM hours, (VALUES {_PLACES}) c(place, channel), range({SIDE * SIDE}) cells(k)) LEFT JOIN whole USING (hour, channel, k))"""


@query(
    "g8_gridded_stack",
    sql(
        f""", {CUBE_SQL} SELECT hour, place::INTEGER AS place, channel, count(*)::INTEGER AS cells, count_if(gap)::INTEGER AS gaps, {steady_sql('avg(value)', 4)} AS mean,
        {steady_sql('min(value)', 4)} AS low, {steady_sql('max(value)', 4)} AS high, {steady_sql('avg(value * (k + 1))', 2)} AS moment FROM cube GROUP BY ALL""",
        "st", "h_small", "hp", "px",
    ),
)
def g8_gridded(spark, sf_dir):
    """Each hour's twelve channels as dense arrays; the query returns what tells the arrays apart, cell by cell."""
    cube = the_cube(spark, sf_dir).withColumnRenamed("cells", "c")
    total = lambda f: F.aggregate(F.transform("c", f), F.lit(0.0), lambda a, x: a + x) / F.size("c")
    return cube.select(
        "hour", "place", "channel", F.size("c").alias("cells"), "gaps", steady(total(lambda v: v), 4).alias("mean"),
        steady(F.array_min("c"), 4).alias("low"), steady(F.array_max("c"), 4).alias("high"), steady(total(lambda v, k: v * (k + 1)), 2).alias("moment"),
    )


_TRUE = ", ".join(f"max(value) FILTER (channel = '{c}') AS {c}" for c in C.SCALES)
_OFF = [f"(p.{c} - t.{c}) / {s}" for c, s in C.SCALES.items()]
F6_SQL = f""", {CUBE_SQL}, wide AS MATERIALIZED (SELECT hour, k, {_TRUE} FROM cube WHERE channel IN {tuple(C.SCALES)} GROUP BY hour, k),
    meet AS (SELECT p.*, t.pm25 AS tp, t.pbl AS tb, ({' + '.join(f'pow({x}, 2)' for x in _OFF)}) / 4 AS sq, ({' + '.join(f'abs({x})' for x in _OFF)}) / 4 AS ab
      FROM wide t JOIN (SELECT hour + INTERVAL 1 DAY AS hour, k, pm25, u_wind, v_wind, pbl FROM wide) p ON p.hour = t.hour AND p.k = t.k),
    ahead AS (SELECT m.*, extract(hour FROM m.hour) AS lead, n.pm25 AS nxt FROM meet m LEFT JOIN meet n ON n.k = m.k AND n.hour = m.hour + INTERVAL 1 HOUR AND n.hour::DATE = m.hour::DATE),
    each AS (SELECT lead, sq, ab, CASE WHEN nxt IS NOT NULL THEN CASE WHEN sqrt(u_wind * u_wind + v_wind * v_wind) < 2 AND pbl < 400 THEN greatest(0.0::DOUBLE, (pm25 - nxt) / 500) ELSE 0 END END AS co,
      CASE WHEN tb < 400 AND tp > 300 THEN CASE WHEN tp > pm25 THEN 2 ELSE 0.5 END * pow((tp - pm25) / 500, 2) END AS inv FROM ahead),
    r AS (SELECT lead, count(*) AS n, avg(sq) AS mse, avg(ab) AS mae, avg(co) AS conservation, coalesce(avg(inv), 0) AS inversion FROM each GROUP BY ROLLUP (lead))
    SELECT lead::INTEGER AS lead, n, {', '.join(f"{steady_sql(c, 7)} AS {c}" for c in ('mse', 'mae', 'conservation', 'inversion'))},
    {steady_sql('mse + 0.5 * mae + 2 * coalesce(conservation, 0) + 1.5 * inversion', 7)} AS total FROM r"""


@query("f6_physics_losses", sql(F6_SQL, "st", "h_small", "hp", "px"))
def f6(spark, sf_dir):
    """The fields of a day as the forecast of the next one, judged by what still air allows: a row a lead and one over all."""
    fields = written(C.fields(the_cube(spark, sf_dir), SIDE, list(C.SCALES)), "fields")
    at = lambda df: df.withColumns({"day": F.to_date("hour"), "lead": F.hour("hour")}).drop("hour")
    pred = at(fields.withColumn("hour", F.col("hour") + F.expr("interval 1 day")))
    losses = C.physics_losses(pred, at(fields), ["day"])
    return losses.select("lead", "n", *[steady(F.col(c), 7).alias(c) for c in ("mse", "mae", "conservation", "inversion", "total")])


@query("g13_streamlines")
def g13(spark, sf_dir):
    """Lines along each day's wind, which turns at the ridges: the flow between all stations' winds of that day."""
    h = h_small(spark, sf_dir).groupBy(F.col("station_id").alias("id"), F.to_date("hour").alias("day")).agg(F.avg("value").alias("value"))
    winds = h.join(stations(spark, sf_dir).select("id", "lat", "lon"), "id").withColumn("from_deg", F.col("value") * 7 % 360)
    flow = written(FL.flow(SP.grid(spark, 24, 24), winds, by=["day"]), "flow")  # what follows fills a generated method by itself
    u, v, _ = FL.terrain_wind(F.col("lat"), F.col("lon"), F.col("u"), F.col("v"), 0.5, 3.0)
    field = flow.select("day", "gy", "gx", u.alias("u"), v.alias("v"))
    lines = streamlines(field, 24, 24, ["day"], (g["south"], g["north"], g["west"], g["east"]))
    ends = lambda i: [F.round(F.element_at("points", i)[c], 6) for c in ("lat", "lon")]
    (a, b), (c, d) = ends(1), ends(-1)
    return lines.select("day", "line", F.size("points").alias("n"), a.alias("lat1"), b.alias("lon1"), c.alias("lat2"), d.alias("lon2"))
