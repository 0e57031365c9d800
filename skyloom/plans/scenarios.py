"""Queries of scenarios, of interventions and of a live feed that stands in for a late archive, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import forecast as FC
from ..operators import matching as M
from ..operators import scenario as SC
from ..operators import timeseries as S
from ..sources.bridge import SMALL, sql, stations, steady, steady_sql
from .expressions import ladder_sql
from .geography import greedy_sql
from .registry import Registry
from .relations import FIT_SQL, N_SQL, fitted
from .series import h_small, hp

REG = Registry()
query = REG.query


def _noise(x: str) -> str:
    s = f"sin(({x}) * 12.9898::DOUBLE) * 43758.5453::DOUBLE"
    return f"({s} - floor({s}))"


def _clamp(x: str, a: float, b: float) -> str:
    return f"greatest({a}::DOUBLE, least({b}::DOUBLE, {x}))"


_WIND = _clamp(
    "1.5 + 1.9 * greatest(0.0::DOUBLE, sin((lh - 8) / 24 * pi() * 2)) + 0.7 * sin(h / 19.0::DOUBLE * pi())"
    f" + 0.6 * ({_noise('h * 7.31 + di * 3.77')} - 0.5) + dy * 0.35",
    0.3,
    7.5,
)
_SOLAR = """CASE WHEN (lh - 6.2) / 11.6 <= 0 OR (lh - 6.2) / 11.6 >= 1 THEN 0.0
      ELSE 720 * sin(pi() * (lh - 6.2) / 11.6) END * exp(-0.62 * aod)"""
_PBL = _clamp(f"236 + {_noise('di * 5.1 + dy')} * 96 + pow(solar / 720, 0.85) * 1750 * (exp(-0.62 * aod) * 0.45 + 0.55)", 60, 1900)
_AIR = _clamp("pbl / 900 * (wind / 4.5 + 0.42)", 0.45, 1.15)
_PM = _clamp(f"(emission * ef * (0.625 * 41) + (sin(h / 17.0::DOUBLE) * 7 + 12) * 0.625) / {_AIR}", 6, 780)


def steps_sql(name: str, districts: str, stubble: float = 1.0, traffic: float = 1.0, industry: float = 1.0) -> str:
    """The recursion over hours for each row of a table expression of districts, with what is left of each source."""
    ef = f"stubble * {stubble}::DOUBLE + traffic * {traffic}::DOUBLE + industry * {industry}::DOUBLE"
    return f"""{name} AS (
    SELECT di, district, emission, {ef} AS ef, -1::BIGINT AS h, 0.0::DOUBLE AS pm, 0.0::DOUBLE AS pbl, 0.0::DOUBLE AS solar,
      0.0::DOUBLE AS wind, 0.55 * ({ef}) + 0.2 AS aod FROM {districts}
    UNION ALL
    SELECT di, district, emission, ef, h, pm, pbl, solar, wind, {_clamp("aod * 0.62 + pm / 210 * 0.38", 0.05, 2.2)}
    FROM (SELECT *, {_PM} AS pm FROM (SELECT *, {_PBL} AS pbl FROM (SELECT *, {_SOLAR} AS solar, {_WIND} AS wind
    FROM (SELECT di, district, emission, ef, aod, h + 1 AS h, ((h + 20) % 24)::DOUBLE AS lh, floor((h + 20) / 24.0::DOUBLE) AS dy
      FROM {name} WHERE h < 72) q1) q2) q3) q4)"""


def _client_sql(x: str) -> str:
    return f"floor(coalesce({ladder_sql(x, T.CLIENT_PM25, True)}, ({x} - 250) * (99.0::DOUBLE / 750) + 401) + 0.5)::INTEGER"


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


#: A station's sources, by what its pollutants' means make up of their sum: particles, nitrogen dioxide, the others.
_MIX = {"stubble": ("pm25", "pm10"), "traffic": ("no2",), "industry": ("so2", "o3")}
_MIX_SQL = ", ".join(
    f"round(coalesce(sum(mean) FILTER (parameter IN ({', '.join(repr(p) for p in ps)})), 0) / sum(mean), 6) AS {name}"
    for name, ps in _MIX.items()
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations as districts of the scenario: emission by their mean, sources by the pollutants' shares."""
    mean = hp(spark, sf_dir, SMALL).groupBy("station_id", "parameter").agg(F.round(F.avg("value"), 6).alias("mean"))
    share = lambda ps: F.round(F.coalesce(F.sum(F.when(F.col("parameter").isin(*ps), F.col("mean"))), F.lit(0.0)) / F.sum("mean"), 6)
    mix = [share(ps).alias(name) for name, ps in _MIX.items()]
    emission = F.round(F.avg("mean") / 50, 6).alias("emission")
    d = mean.groupBy(F.col("station_id").alias("id")).agg(emission, *mix)
    return d.join(stations(spark, sf_dir), "id").select(F.col("id").cast("int").alias("di"), F.col("name").alias("district"), "emission", *_MIX)


@query(
    "f4_scenario",
    recursive(
        sql(
            f""", means AS (SELECT station_id, parameter, round(avg(value), 6) AS mean FROM hp GROUP BY ALL),
            d AS MATERIALIZED (SELECT m.*, st.name AS district FROM (SELECT station_id AS id, station_id AS di, round(avg(mean) / 50, 6) AS emission, {_MIX_SQL}
              FROM means GROUP BY station_id) m JOIN st USING (id)), {steps_sql("r", "d", 0.6, 0.75, 0.9)}
            SELECT district, h::INTEGER AS hour, floor(pm * 10 + 0.5) / 10 AS pm25, {_client_sql("pm")} AS aqi, floor(pbl + 0.5)::BIGINT AS pbl,
              floor(solar + 0.5)::BIGINT AS solar, floor(wind * 10 + 0.5) / 10 AS wind FROM r WHERE h >= 0""",
            "hp", "st",
        )
    ),
)
def f4(spark, sf_dir):
    """Every station's frames under cuts of its sources: less stubble, traffic and industry."""
    return SC.frames(sources(spark, sf_dir), 40, 25, 10).select("district", "hour", "pm25", "aqi", "pbl", "solar", "wind")


def districts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SC.DISTRICTS, SC.DISTRICT_SCHEMA)


_DISTRICTS = ", ".join(
    f"({i}, '{n}', {', '.join(f'{x}::DOUBLE' for x in rest)})" for i, n, *rest in SC.DISTRICTS
)
_D = f"d AS (SELECT * FROM (VALUES {_DISTRICTS}) x(di, district, lat, lon, emission, stubble, traffic, industry))"
_KM = "sqrt(pow((st.lat - d.lat) * 111.0::DOUBLE, 2) + pow((st.lon - d.lon) * 97.5::DOUBLE, 2))"
_LEVEL = "CASE WHEN x / 120 + 0.4 * 0.75 > 1.65 THEN 'EMERGENCY' WHEN x / 120 + 0.4 * 0.75 > 1.2 THEN 'WARNING' WHEN x / 120 + 0.4 * 0.75 > 0.8 THEN 'ADVISORY' ELSE 'NOMINAL' END"


@query(
    "f5_interventions",
    recursive(
        sql(
            f""", {_D}, near AS (SELECT st.id AS station_id, arg_min(district, {_KM} * 1000 + di * 1e-9) AS district FROM st, d GROUP BY st.id),
            live AS (SELECT district, (epoch(hour)::BIGINT // 3600 % 73)::INTEGER AS hour, {steady_sql('avg(value)')} AS pm25 FROM h_small JOIN near USING (station_id) GROUP BY ALL),
            {steps_sql("base", "d")}, {steps_sql("cut", "d", 0.6, 0.75, 0.9)},
            ratio AS (SELECT b.district, b.h AS hour, floor(b.pm * 10 + 0.5) / 10 AS b, floor(c.pm * 10 + 0.5) / 10 AS s FROM base b JOIN cut c ON c.district = b.district AND c.h = b.h WHERE b.h >= 0),
            q AS (SELECT live.district, live.hour, pm25 * CASE WHEN b > 0 THEN s / b ELSE 1 END AS x FROM live LEFT JOIN ratio USING (district, hour))
            SELECT district, hour, floor(x * 10 + 0.5) / 10 AS pm25, {_client_sql("x")} AS aqi, {_LEVEL} AS alert FROM q""",
            "st", "h_small",
        )
    ),
)
def f5(spark, sf_dir):
    """Every station belongs to the district nearest to it; a district's frame is the mean of its stations."""
    places = districts(spark).select(F.col("di").alias("id"), "lat", "lon")
    near = M.neighbours(stations(spark, sf_dir).select(F.col("id").alias("station_id"), "lat", "lon"), places, 1, ["station_id"])
    name = F.get(F.array(*[F.lit(d[1]) for d in SC.DISTRICTS]), F.col("id")).alias("district")
    frame = (F.unix_seconds(F.col("hour").cast("timestamp")) / 3600 % 73).cast("int").alias("hour")
    own = h_small(spark, sf_dir).join(near, "station_id")
    live = own.groupBy(name, frame).agg(steady(F.avg("value")).alias("pm25"), F.lit(0.4).alias("inversion"))
    return SC.with_interventions(live, SC.frames(districts(spark)), SC.frames(districts(spark), 40, 25, 10))


#: The archive ends so many hours before the origin of the forecast.
_LATE = 20
_F3 = f"""{N_SQL}, {FIT_SQL}, og AS (SELECT max(hour) - INTERVAL 96 HOUR AS origin FROM n),
    arch AS (SELECT id AS a, lat, lon FROM st WHERE id IN (SELECT station_id FROM n)),
    feed AS (SELECT id + 1000000 AS b, id, lat + 0.006::DOUBLE AS lat, lon + 0.004::DOUBLE AS lon FROM st WHERE id IN (SELECT station_id FROM n)),
    near AS MATERIALIZED (SELECT a, b, sqrt(pow((arch.lat - feed.lat) * 111.0::DOUBLE, 2) + pow((arch.lon - feed.lon) * 97.5::DOUBLE, 2)) AS km FROM arch, feed
      WHERE sqrt(pow((arch.lat - feed.lat) * 111.0::DOUBLE, 2) + pow((arch.lon - feed.lon) * 97.5::DOUBLE, 2)) <= 2),
    {greedy_sql("near")}, late AS MATERIALIZED (SELECT n.station_id, hour, CASE WHEN hour <= origin - INTERVAL {_LATE} HOUR THEN obs END AS obs, model FROM n, og),
    live AS MATERIALIZED (SELECT g.a AS station_id, h.hour, h.value FROM greedy g JOIN feed USING (b) JOIN h_small h ON h.station_id = feed.id, og WHERE h.hour <= origin),
    q AS (SELECT hour, avg((obs IS NOT NULL)::INTEGER) AS share FROM late GROUP BY hour), lq AS (SELECT hour, count(value) AS k FROM live GROUP BY hour),
    sx AS (SELECT DISTINCT station_id FROM n), ll AS (SELECT station_id, unnest(generate_series(1, 72)) AS lead FROM sx),
    lx AS (SELECT ll.*, origin + to_hours(lead) AS hour, origin + to_hours(lead - 24) AS back FROM ll, og),
    j AS (SELECT lx.station_id, lx.lead, t.model * wh.scale AS m, coalesce(q.share >= 0.5, false) AS ours, coalesce(k / (SELECT count(*) FROM sx)::DOUBLE >= 0.5, false) AS theirs,
      y.obs, live.value AS theirs_value FROM lx LEFT JOIN n t USING (station_id, hour) LEFT JOIN late y ON y.station_id = lx.station_id AND y.hour = lx.back
      LEFT JOIN q ON q.hour = lx.back LEFT JOIN lq ON lq.hour = lx.back LEFT JOIN live ON live.station_id = lx.station_id AND live.hour = lx.back, wh),
    r AS (SELECT *, CASE WHEN ours THEN obs WHEN theirs THEN theirs_value END AS day FROM j)
    SELECT station_id, lead::INTEGER AS lead, {steady_sql("coalesce((day + m) / 2, day, m)")} AS value,
      CASE WHEN ours THEN 'blend' WHEN theirs THEN 'blend_live' ELSE 'model_only' END AS method FROM r"""


@query("f3_live_diurnal", recursive(sql(", " + _F3, "h_small", "st")))
def f3(spark, sf_dir):
    """A forecast for all stations where the archive ends before its origin: yesterday's hours that it lacks come from the live
    feed, whose sites lie beside the archive's and are paired with them one to one within two kilometres."""
    d, whole, _ = fitted(spark, sf_dir)
    origin = d.agg((F.max("hour") - F.expr("interval 96 hours")).alias("origin"))
    ids = d.select(F.col("station_id").alias("id")).distinct()
    archive = stations(spark, sf_dir).join(ids, "id", "left_semi")
    feed = archive.select((F.col("id") + 1_000_000).alias("id"), "lat", "lon").select("id", (F.col("lat") + 0.006).alias("lat"), (F.col("lon") + 0.004).alias("lon"))
    pairs = M.in_turn(archive, feed, 2.0)
    recorded = h_small(spark, sf_dir).join(F.broadcast(origin)).where("hour <= origin")  # one row
    live = pairs.select(F.col("a").alias("borrower"), (F.col("b") - 1_000_000).alias("station_id")).join(recorded, "station_id")
    live = live.select(F.col("borrower").alias("station_id"), "hour", "value")
    known = F.when(F.col("hour") <= F.col("origin") - F.expr(f"interval {_LATE} hours"), F.col("obs"))
    late = d.join(F.broadcast(origin)).withColumn("obs", known).drop("origin")
    shares = S.quorum(late, value="obs")
    out = FC.blend(d, late, "station_id", origin, whole, shares, live)
    return out.select("station_id", "lead", steady(F.col("value")).alias("value"), "method")
