"""Queries of district lattices, slices nearest in time and published figures, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lattice as L
from ..operators import selection as SE
from ..sources.bridge import SMALL, observations, sql, stations, steady, steady_sql
from ..sources.scratch import written
from .registry import Registry
from .series import h_small

REG = Registry()
query = REG.query
#: Districts are groups of stations by id, their places the means of their stations'.
DISTRICTS = 12


def binned(at: str, hours: int):
    """The start of the span of so many hours of the day that a moment lies in."""
    day = F.date_trunc("day", at).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.floor(F.hour(at) / hours).cast("int") * hours)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, district, lat, lon, pm25, wind_dir, wind_speed, inversion): a frame each six hours."""
    district = lambda c: (F.col(c) % DISTRICTS).alias("district")
    places = stations(spark, sf_dir).groupBy(district("id")).agg(*[steady(F.avg(c)).alias(c) for c in ("lat", "lon")])
    air = h_small(spark, sf_dir).groupBy(district("station_id"), binned("hour", 6).alias("frame")).agg(steady(F.avg("value")).alias("pm25"))
    x = F.col("pm25")
    wind = {"wind_dir": x * 7 % 360, "wind_speed": x / 60, "inversion": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - x / 400))}
    return air.join(places, "district").withColumns(wind)


_BIN = "date_trunc('day', {0}) + to_hours((extract(hour FROM {0}) // {1} * {1})::INTEGER)"
FRAMES_SQL = f""", places AS (SELECT id % {DISTRICTS} AS district, {steady_sql('avg(lat)')} AS lat, {steady_sql('avg(lon)')} AS lon FROM st GROUP BY 1),
    air AS (SELECT station_id % {DISTRICTS} AS district, {_BIN.format('hour', 6)} AS frame, {steady_sql('avg(value)')} AS pm25 FROM h_small GROUP BY ALL),
    d AS MATERIALIZED (SELECT frame, lat AS dlat, lon AS dlon, pm25, radians(pm25 * 7 % 360) AS rad, pm25 / 60 AS speed,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - pm25 / 400)) AS inversion FROM air JOIN places USING (district)),"""


def _cells_sql(side: int) -> str:
    step = lambda low, high, c: f"{low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) / {side} * ({c} + 0.5::DOUBLE)"
    return f"""c AS (SELECT gy::INTEGER AS gy, gx::INTEGER AS gx, {step(L.SOUTH, L.NORTH, 'gy')} AS lat, {step(L.WEST, L.EAST, 'gx')} AS lon
      FROM range({side}) a(gy), range({side}) b(gx))"""


_PLUME_SQL = f"""{FRAMES_SQL} {_cells_sql(L.PLUME_SIDE)},
    m AS (SELECT frame, gy, gx, lat, lon, pm25, lat - (dlat - cos(rad) * speed / 5 * 0.12::DOUBLE) AS y, lon - (dlon - sin(rad) * speed / 5 * 0.12::DOUBLE) AS x,
      0.1::DOUBLE + 0.055::DOUBLE * (1 - inversion) + speed * 0.012::DOUBLE AS wide FROM d, c)
    SELECT frame, gy, gx, round(lat, 6) AS lat, round(lon, 6) AS lon, {steady_sql('sum(pm25 * exp(-(y * y + x * x) / (2 * wide * wide))) / 1.9::DOUBLE', 5)} AS value FROM m GROUP BY ALL"""


@query("g14_district_plumes", sql(_PLUME_SQL, "st", "h_small"))
def g14_plumes(spark, sf_dir):
    cells = L.plume_lattice(frames(spark, sf_dir), "frame")
    return cells.select("frame", "gy", "gx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), steady(F.col("value"), 5).alias("value"))


_WIND_SQL = f"""{FRAMES_SQL} {_cells_sql(L.WIND_SIDE)},
    m AS (SELECT frame, gy, gx, rad, speed, 1 / (0.01::DOUBLE + (lat - dlat) * (lat - dlat) + (lon - dlon) * (lon - dlon)) AS w FROM d, c),
    s AS (SELECT frame, gy, gx, sum(w) AS w, sum(w * cos(rad)) AS x, sum(w * sin(rad)) AS y, sum(w * speed) AS v FROM m GROUP BY ALL)
    SELECT frame, gy, gx, {steady_sql('degrees(atan2(y / w, x / w))', 5)} AS dir, {steady_sql('v / w')} AS speed FROM s"""


@query("g14_district_winds", sql(_WIND_SQL, "st", "h_small"))
def g14_winds(spark, sf_dir):
    cells = L.wind_lattice(frames(spark, sf_dir), "frame")
    return cells.select("frame", "gy", "gx", steady(F.col("dir"), 5).alias("dir"), steady(F.col("speed")).alias("speed"))


_S14_SQL = f""", archive AS MATERIALIZED (SELECT station_id, {_BIN.format('hour', 3)} AS valid_time, {steady_sql('avg(value)')} AS value FROM h_small GROUP BY ALL),
    steps AS (SELECT DISTINCT valid_time FROM archive),
    near AS (SELECT ts, arg_min(valid_time, abs(epoch_us(valid_time) - epoch_us(ts)) * 2 + (valid_time > ts)::INTEGER) AS valid_time
      FROM (SELECT DISTINCT ts FROM obs), steps WHERE abs(epoch_us(valid_time) - epoch_us(ts)) <= 3600000000 GROUP BY ts)
    SELECT o.event_id, o.station_id, n.valid_time, a.value FROM obs o LEFT JOIN near n USING (ts) LEFT JOIN archive a ON a.station_id = o.station_id AND a.valid_time = n.valid_time"""


@query("s14_nearest_slices", sql(_S14_SQL, "obs", "h_small"))
def s14(spark, sf_dir):
    """Every reading beside its station's value in the archive's slice nearest in time, an hour away at most. The archive
    has a slice each three hours and lies in Parquet, partitioned by its day; its moments are read as a column of their own."""
    value = steady(F.avg("value")).alias("value")
    archive = written(h_small(spark, sf_dir).groupBy("station_id", binned("hour", 3).alias("valid_time")).agg(value), "archive")
    asked = observations(spark, sf_dir, SMALL).select("event_id", "station_id", "ts")
    near = SE.nearest_slice(asked, archive.select("valid_time"), "ts", "valid_time")
    return near.join(archive, ["station_id", "valid_time"], "left").select("event_id", "station_id", "valid_time", "value")


_FIGURES = "count(*) FILTER ({0}) AS {1}_n, max(value) FILTER ({0}) AS {1}_top"
_WAS = "ts < TIMESTAMP '2024-01-16'"
_K10_SQL = f""", f AS (SELECT station_id, {_FIGURES.format(_WAS, 'old')}, {_FIGURES.format('true', 'new')} FROM obs GROUP BY station_id),
    t AS (SELECT *, 'Station ' || station_id || ' read ' || old_n || ' times, ' || coalesce(printf('%.2f', old_top), 'none') || ' at most.' AS text,
      old_n || ' times' AS a, new_n || ' times' AS b, printf('%.2f', old_top) || ' at' AS c, printf('%.2f', new_top) || ' at' AS d FROM f)
    SELECT station_id, CASE WHEN c IS NULL THEN text ELSE replace(replace(text, a, b), c, d) END AS text, CASE WHEN c IS NULL THEN '' END AS refused FROM t"""


@query("k10_published_figures", sql(_K10_SQL, "obs"))
def k10(spark, sf_dir):
    """A line a station as published before the sixteenth, with the figures of all readings put in place of those of then."""
    was = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    top = lambda v: F.format_string("%.2f", F.max(v))
    then = F.when(was, F.col("value"))
    f = observations(spark, sf_dir, SMALL).groupBy("station_id").agg(
        F.count_if(was).alias("old_n"), F.count("*").alias("new_n"),
        F.when(F.max(then).isNotNull(), top(then)).alias("old_top"), top(F.col("value")).alias("new_top"),
    )
    text = F.format_string("Station %d read %d times, %s at most.", "station_id", "old_n", F.coalesce("old_top", F.lit("none")))
    lines = f.withColumn("line", text)
    times, most = (lambda c: F.concat(F.col(c).cast("string"), F.lit(" times"))), (lambda c: F.concat(c, F.lit(" at")))
    new = SE.patched(F.col("line"), [(times("old_n"), times("new_n")), (most("old_top"), most("new_top"))])
    return lines.select("station_id", new.alias("p")).select("station_id", "p.text", "p.refused")
