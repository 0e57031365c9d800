"""Queries of joins by place and time, of grids and of fires, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import tables as T
from ..functions.parse import detected_at
from ..operators import fires as FI
from ..operators import matching as M
from ..operators import spatial as SP
from ..sources.bridge import SMALL, observations, pixels, sql, stations, steady
from ..sources.scratch import written
from .expressions import BAND_SQL, STATE_SQL, _bear, _compass, _hav
from .registry import Registry
from .series import h_small, hp

REG = Registry()
query = REG.query
g = T.GRID
GRID_SQL = f"g AS MATERIALIZED (SELECT gy, gx, {g['south']}::DOUBLE + gy * (({g['north']}::DOUBLE - {g['south']}::DOUBLE) / 69) AS glat, {g['west']}::DOUBLE + gx * (({g['east']}::DOUBLE - {g['west']}::DOUBLE) / 79) AS glon FROM range(70) a(gy), range(80) b(gx))"
FLAT = "sqrt(pow((a.lat - b.lat) * 111, 2) + pow((a.lon - b.lon) * 97.5, 2))"


def split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = stations(spark, sf_dir)
    return s.where("id % 5 = 0"), s.where("id % 5 <> 0")


SPLIT_SQL = "live AS (SELECT * FROM st WHERE id % 5 = 0), arch AS (SELECT * FROM st WHERE id % 5 <> 0)"


@query("j5_without_near", sql(f", {SPLIT_SQL} SELECT id, name FROM arch a WHERE NOT EXISTS (SELECT 1 FROM live b WHERE {FLAT} <= 4)", "st"))
def j5(spark, sf_dir):
    live, archive = split(spark, sf_dir)
    return M.without_near(archive, live, 4.0).select("id", "name")


def greedy_sql(pairs: str) -> str:
    """Table expressions that end in greedy (a, b, km): each a in turn takes its nearest b that is left, a row at a time."""
    free = "NOT list_contains(w.used, p.b)"
    return f"""turns AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM {pairs})),
    walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS km, []::BIGINT[] AS used
      UNION ALL
      SELECT i, a, b, km, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END FROM (
        SELECT t.i, t.a, any_value(w.used) AS used, min_by(p.b, {{'km': p.km, 'b': p.b}}) FILTER (WHERE {free}) AS b, min(p.km) FILTER (WHERE {free}) AS km
        FROM walk w JOIN turns t ON t.i = w.i + 1 JOIN {pairs} p ON p.a = t.a GROUP BY t.i, t.a)),
    greedy AS (SELECT a, b, km FROM walk WHERE b IS NOT NULL)"""


_J6 = f"""SPLIT, near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {FLAT} AS km FROM arch a JOIN live b ON {FLAT} <= 12), {greedy_sql("near")}
    SELECT a, b, round(km + 1.37e-9, 6) AS km FROM greedy"""


@query("j6_exclusive_nearest", sql(", " + _J6.replace("SPLIT", SPLIT_SQL), "st").replace("WITH ", "WITH RECURSIVE ", 1))
def j6(spark, sf_dir):
    live, archive = split(spark, sf_dir)
    return M.in_turn(archive, live, 12.0).select("a", "b", steady(F.col("km")).alias("km"))


@query("j7_nearest_in_time", sql(""", p AS (SELECT event_id, station_id, ts FROM obs WHERE parameter = 'so2'), r AS (SELECT DISTINCT station_id, hour FROM hp WHERE parameter = 'o3' AND extract(hour FROM hour) % 6 = 0),
    c AS (SELECT event_id, hour, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(hour)), hour) AS rn FROM p JOIN r USING (station_id) WHERE abs(epoch_us(ts) - epoch_us(hour)) <= 129600000000)
    SELECT p.event_id, c.hour AS nearest FROM p LEFT JOIN c ON p.event_id = c.event_id AND c.rn = 1""", "obs", "hp"))  # fmt: skip
def j7(spark, sf_dir):
    obs = observations(spark, sf_dir, SMALL)
    left = obs.where("parameter = 'so2'").select("event_id", "station_id", "ts")
    right = hp(spark, sf_dir, SMALL).where("parameter = 'o3' and hour(hour) % 6 = 0").select("station_id", F.col("hour").alias("ts"))
    return M.nearest_in_time(left, right, ["station_id"], "ts", 36).select("event_id", "nearest")


@query("j8_greedy_matching")
def j8(spark, sf_dir):
    live, archive = split(spark, sf_dir)
    x, y = (d.select("id", "lat", "lon", M.tokens(F.col("name")).alias("words")) for d in (live, archive))
    x = written(M.alike(x, y), "alike")
    p = M.pairs_within(x.where(F.col("id") == F.col("group")), y, 12.0)
    named = p.join(x.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(y.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    fit = named.where((F.col("km") <= 0.25) | F.arrays_overlap("x", "y")).select("a", "b", "km")
    found = M.exclusive(fit, ["km"], ["km"], x.select(F.col("group").alias("a"), "id"))
    return found.select("a", "b", steady(F.col("km")).alias("km"))


KNN_SQL = f"{GRID_SQL}, kk AS MATERIALIZED (SELECT gy, gx, id, km, row_number() OVER (PARTITION BY gy, gx ORDER BY km, id) AS rank FROM (SELECT gy, gx, id, sqrt(pow((lat - glat) * 111.0::DOUBLE, 2) + pow((lon - glon) * 97.5::DOUBLE, 2)) AS km FROM g, st)), k AS (SELECT * FROM kk WHERE rank <= 8)"


@query("j9_nearest_stations", sql(f", {KNN_SQL} SELECT gy, gx, id, rank::INTEGER AS rank, round(km, 6) AS km FROM k", "st"))
def j9(spark, sf_dir):
    return SP.nearest_stations(SP.grid(spark), stations(spark, sf_dir)).select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "id", "rank", F.round("km", 6).alias("km"))


@query("j13_season_sensors", sql(""", l AS (SELECT station_id, parameter, sensor_id, min(ts)::DATE AS first, max(ts)::DATE AS last FROM obs WHERE extract(day FROM ts) % (sensor_id % 4 + 2) = 1 GROUP BY ALL),
    w AS (SELECT DATE '2024-01-05' AS a, DATE '2024-01-24' AS b), c AS (SELECT l.*, CASE WHEN last >= a AND first <= b AND last >= first THEN (date_diff('day', greatest(first, a), least(last, b)) + 1) / 20.0::DOUBLE ELSE 0 END AS share, least(last, b) AS reach FROM l, w)
    SELECT station_id, parameter, sensor_id, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY station_id, parameter ORDER BY reach DESC, sensor_id) AS rn FROM c WHERE share >= 0.5) WHERE rn = 1""", "obs"))  # fmt: skip
def j13(spark, sf_dir):
    o = observations(spark, sf_dir, SMALL).where("day(ts) % (sensor_id % 4 + 2) = 1")
    life = o.groupBy("station_id", "parameter", "sensor_id").agg(F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last"))
    a, b = F.lit("2024-01-05").cast("date"), F.lit("2024-01-24").cast("date")
    c = life.withColumn("share", M.overlap_share(F.col("first"), F.col("last"), a, b)).where("share >= 0.5")
    best = c.groupBy("station_id", "parameter").agg(F.max(F.struct(F.least("last", b).alias("reach"), (-F.col("sensor_id")).alias("s"), "share")).alias("t"))
    return best.select("station_id", "parameter", (-F.col("t.s")).alias("sensor_id"), F.round("t.share", 6).alias("share"))


@query("j14_recent_events", sql(", hh AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM obs), e AS (SELECT ts, value FROM obs WHERE parameter = 'so2') SELECT hour, count(*) AS n, round(sum(value) + 1.37e-9, 6) AS total FROM hh JOIN e ON ts <= hour AND ts >= hour - INTERVAL 6 HOUR GROUP BY hour", "obs"))
def j14(spark, sf_dir):
    obs = observations(spark, sf_dir, SMALL)
    hours = obs.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    near = M.hours_after(obs.where("parameter = 'so2'").select("ts", "value"), "ts", 6)
    return near.join(hours, "hour").groupBy("hour").agg(F.count("*").alias("n"), steady(F.sum("value")).alias("total"))


@query("j16_grid_cells", sql("SELECT id, greatest(0, least(69, ceil(round((lat - 28.2::DOUBLE) / (0.7::DOUBLE / 69), 9))))::INTEGER AS gy, greatest(0, least(79, ceil(round((lon - 76.8::DOUBLE) / (0.8::DOUBLE / 79), 9))))::INTEGER AS gx FROM st", "st"))
def j16(spark, sf_dir):
    y, x = G.grid_index(F.col("lat"), F.col("lon"))
    return stations(spark, sf_dir).select("id", y.alias("gy"), x.alias("gx"))


@query("j17_channel_lookup", "SELECT c.* FROM (VALUES " + ", ".join(f"('{n}', '{u}', {o}::DOUBLE, {s}::DOUBLE)" for n, u, o, s, _ in T.CHANNELS) + ") c(name, unit, \"offset\", scale) WHERE name IN (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'o3' END FROM events)")
def j17(spark, sf_dir):
    spec = spark.createDataFrame([c[:4] for c in T.CHANNELS], "name string, unit string, offset double, scale double")
    used = observations(spark, sf_dir, SMALL).select(F.col("parameter").alias("name")).distinct()
    return used.join(F.broadcast(spec), "name").select("name", "unit", "offset", "scale")  # twelve rows


V = "v AS (SELECT station_id AS id, value FROM h_small WHERE hour = (SELECT max(hour) FROM h_small))"


def _snapshot(spark, sf_dir) -> DataFrame:
    h = h_small(spark, sf_dir)
    return h.join(F.broadcast(h.agg(F.max("hour").alias("hour"))), "hour").select(F.col("station_id").alias("id"), "value")  # one row


@query("g1_idw_grid", sql(f", {KNN_SQL}, {V} SELECT gy, gx, round(sum(value / (km * km)) / sum(1 / (km * km)), 6) AS value FROM k JOIN v USING (id) GROUP BY gy, gx".replace("km * km", "CASE WHEN km = 0 THEN 1e-26 ELSE km * km END"), "st", "h_small"))
def g1(spark, sf_dir):
    w = SP.nearest_stations(SP.grid(spark), stations(spark, sf_dir))
    f = SP.weighted(w, _snapshot(spark, sf_dir), ["gy", "gx"])
    return f.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round("value", 6).alias("value"))


@query("g5_nearest_fill", sql(f", {GRID_SQL}, {V}, n AS (SELECT gy, gx, id, row_number() OVER (PARTITION BY gy, gx ORDER BY sqrt(pow((lat - glat) * 111.0::DOUBLE, 2) + pow((lon - glon) * 97.5::DOUBLE, 2)), id) AS rn FROM g, st JOIN v USING (id)) SELECT gy, gx, value FROM n JOIN v USING (id) WHERE rn = 1", "st", "h_small"))
def g5(spark, sf_dir):
    v = _snapshot(spark, sf_dir)
    known = stations(spark, sf_dir).join(v.select("id"), "id", "left_semi")
    near = SP.nearest_stations(SP.grid(spark), known, k=1).join(v, "id")
    return near.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "value")


@query(
    "g7_plume",
    sql(f""", {GRID_SQL}, p AS (SELECT gy, gx, frp, (glon - lon) * 97.5::DOUBLE AS dx, (glat - lat) * 111.0::DOUBLE AS dy FROM px, g),
    a AS (SELECT *, dx * (3.0::DOUBLE / 5) + dy * (-4.0::DOUBLE / 5) AS al, abs(dy * (3.0::DOUBLE / 5) - dx * (-4.0::DOUBLE / 5)) AS ac FROM p)
    SELECT gy, gx, round(sum(frp * exp(-(dx * dx + dy * dy) / 4050)) * 0.22, 2) AS frp, round(sum(CASE WHEN al > 0 AND al / 18 <= 72 THEN frp * exp(-(ac * ac) / 4050) / (1 + al / 200) * (2.0::DOUBLE / 5) ELSE 0 END) * 0.22, 2) AS smoke FROM a GROUP BY gy, gx""", "px"),
)
def g7(spark, sf_dir):
    f = SP.plume(SP.grid(spark), pixels(spark, sf_dir).select("lat", "lon", "frp"), 3.0, -4.0)
    return f.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round("frp", 2).alias("frp"), F.round("smoke", 2).alias("smoke"))


@query(
    "g9_left_out",
    sql(""", s AS (SELECT * FROM st WHERE id IN (SELECT station_id FROM h_small)), r AS (SELECT a.id AS a, b.id, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow((b.lat - a.lat) * 111.0::DOUBLE, 2) + pow((b.lon - a.lon) * 97.5::DOUBLE, 2)), b.id) AS rank, 1 / pow(greatest(1e-9, sqrt(pow((b.lat - a.lat) * 111.0::DOUBLE, 2) + pow((b.lon - a.lon) * 97.5::DOUBLE, 2))), 2) AS w FROM s a, s b WHERE a.id <> b.id),
    q AS (SELECT a, hour, sum(w * value) / sum(w) AS idw, arg_min(value, rank) AS nearest FROM r JOIN h_small ON h_small.station_id = r.id WHERE rank <= 8 GROUP BY a, hour)
    SELECT h.station_id AS id, h.hour, h.value AS truth, round(q.idw + 1.37e-9, 6) AS idw, q.nearest FROM h_small h LEFT JOIN q ON q.a = h.station_id AND q.hour = h.hour""", "st", "h_small"),
)
def g9(spark, sf_dir):
    h = h_small(spark, sf_dir).withColumnRenamed("station_id", "id")
    return SP.left_out(stations(spark, sf_dir).join(h, "id", "left_semi"), h).select("id", "hour", "truth", steady(F.col("idw")).alias("idw"), "nearest")


@query(
    "g10_client_grid",
    sql(f""", {V}, c AS (SELECT y, x, 28.2::DOUBLE + y * 0.7::DOUBLE / 17 AS glat, 76.8::DOUBLE + x * 0.8::DOUBLE / 17 AS glon FROM range(18) a(y), range(18) b(x)), w AS (SELECT y, x, value, 1 / (pow((lat - glat) * 111.0::DOUBLE, 2) + pow((lon - glon) * 97.5::DOUBLE, 2) + 0.01) AS w FROM c, st JOIN v USING (id))
    SELECT y AS gy, x AS gx, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY y, x""", "st", "h_small"),
)
def g10(spark, sf_dir):
    seen = stations(spark, sf_dir).join(_snapshot(spark, sf_dir), "id")
    field = SP.softened(SP.grid(spark, 18, 18), seen)
    return field.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round("value", 6).alias("value"))


CL_SQL = f"""c AS (SELECT *, floor(lat / 0.25)::BIGINT AS cy, floor(lon / 0.25)::BIGINT AS cx, strptime(acq_date || ' ' || lpad(acq_time, 4, '0'), '%Y-%m-%d %H%M') AS seen FROM px),
    q AS (SELECT cy, cx, count(*) AS pixels, sum(frp) AS frp_total, max(frp) AS frp_max, sum(lat * frp) / sum(frp) AS lat, sum(lon * frp) / sum(frp) AS lon, max(seen) AS newest, count(*) FILTER (confidence = 'a') AS conf_a, count(*) FILTER (kind = 0) AS kind_0, count(*) FILTER (satellite = 'O') AS sat_o, count(*) FILTER (extract(hour FROM seen) NOT BETWEEN 6 AND 17) AS nightly FROM c GROUP BY cy, cx HAVING sum(frp) > 0),
    k AS MATERIALIZED (SELECT *, pixels >= 2 AND row_number() OVER (PARTITION BY pixels >= 2 ORDER BY frp_total DESC, cy, cx) <= 24 AS listed, frp_total / (SELECT sum(frp_total) FROM q) * 100 AS share FROM q)"""


@query("a8_fire_clusters", sql(f", {CL_SQL} SELECT cy, cx, pixels, round(frp_total, 6) AS frp_total, frp_max, round(lat, 6) AS lat, round(lon, 6) AS lon, newest, conf_a, kind_0, sat_o, nightly, round(date_diff('minute', newest, TIMESTAMP '2001-12-01') / 60.0::DOUBLE, 6) AS age_h, listed, round(share, 6) AS share_pct, {BAND_SQL} AS band, {STATE_SQL} AS state, round({_hav('lat', 'lon', *T.TARGET)}, 6) AS dist_km FROM k", "px"))
def a8(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("nightly", ~F.hour(detected_at(F.col("acq_date"), F.col("acq_time"))).between(6, 17))
    c = FI.clusters(rows, histograms=("confidence", "kind", "satellite", "nightly"), now=F.lit("2001-12-01").cast("timestamp"))
    r = lambda k: F.round(k, 6).alias(k)
    n = lambda k, of, name: F.coalesce(F.try_element_at(k, F.lit(of)), F.lit(0)).cast("long").alias(name)
    shares = [n("confidence", "a", "conf_a"), n("kind", 0, "kind_0"), n("satellite", "O", "sat_o"), n("nightly", True, "nightly")]
    return c.select("cy", "cx", "pixels", r("frp_total"), "frp_max", r("lat"), r("lon"), F.col("newest").cast("timestamp_ntz").alias("newest"), *shares, r("age_h"), "listed", r("share_pct"), "band", "state", r("dist_km"))


@query("a8_fire_others", sql(f", {CL_SQL} SELECT count(*) AS clusters, sum(pixels)::BIGINT AS pixels, round(sum(frp_total), 6) AS frp_total, count(*) FILTER (pixels < 2) AS isolated FROM k WHERE NOT listed", "px"))
def a8b(spark, sf_dir):
    return FI.others(FI.clusters(pixels(spark, sf_dir))).select("clusters", "pixels", F.round("frp_total", 6).alias("frp_total"), "isolated")


@query("a9_fire_regions", sql(f"SELECT {BAND_SQL} AS band, {STATE_SQL} AS state, count(*) AS pixels, round(sum(frp), 6) AS frp_total, max(frp) AS frp_max, round(min({_hav('lat', 'lon', *T.TARGET)}), 6) AS nearest_km, round(avg({_hav('lat', 'lon', *T.TARGET)}), 6) AS mean_km FROM px GROUP BY 1, 2", "px"))
def a9(spark, sf_dir):
    r = FI.regions(pixels(spark, sf_dir))
    return r.select("band", "state", "pixels", F.round("frp_total", 6).alias("frp_total"), "frp_max", F.round("nearest_km", 6).alias("nearest_km"), F.round("mean_km", 6).alias("mean_km"))


@query("a10_corridor_totals", sql(f""", {CL_SQL}, t AS (SELECT *, CASE WHEN cos(radians({_bear("lat", "lon", *T.TARGET)} - 135.0)) > 0.3 THEN {_hav("lat", "lon", *T.TARGET)} / (12.0 * cos(radians({_bear("lat", "lon", *T.TARGET)} - 135.0))) END AS hours FROM k WHERE listed)
    SELECT (SELECT count(*) FROM px) AS pixels, (SELECT round(sum(frp), 6) FROM px) AS frp_total, (SELECT min(seen) FROM c) AS oldest, (SELECT max(seen) FROM c) AS newest, count(*) FILTER (hours <= 72) AS carrying, round(coalesce(sum(share) FILTER (hours <= 72), 0), 6) AS carrying_share_pct, round(min(hours) FILTER (hours <= 72), 6) AS earliest_h FROM t""", "px"))  # fmt: skip
def a10(spark, sf_dir):
    p = pixels(spark, sf_dir)
    at = detected_at(F.col("acq_date"), F.col("acq_time")).cast("timestamp_ntz")
    whole = p.agg(F.count("*").alias("pixels"), F.round(F.sum("frp"), 6).alias("frp_total"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    c = FI.clusters(p).where("listed")
    align = F.cos(F.radians(G.bearing_deg(F.col("lat"), F.col("lon"), *T.TARGET) - 135.0))
    hours = F.when(align > 0.3, F.col("dist_km") / (12.0 * align))
    c = c.withColumn("h", F.when(hours <= 72, hours))
    there = c.agg(F.count("h").alias("carrying"), F.round(F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("share_pct"))), F.lit(0.0)), 6).alias("carrying_share_pct"), F.round(F.min("h"), 6).alias("earliest_h"))
    return whole.join(F.broadcast(there))  # one row each


@query("a11_fire_centroid", sql("SELECT acq_date, round(sum(lat * frp) / sum(frp), 6) AS lat, round(sum(lon * frp) / sum(frp), 6) AS lon, round(sum(frp), 6) AS frp_total FROM px GROUP BY acq_date", "px"))
def a11(spark, sf_dir):
    f = F.col("frp")
    return pixels(spark, sf_dir).groupBy("acq_date").agg(F.round(F.sum(F.col("lat") * f) / F.sum(f), 6).alias("lat"), F.round(F.sum(F.col("lon") * f) / F.sum(f), 6).alias("lon"), F.round(F.sum(f), 6).alias("frp_total"))


@query("t2_thinned_fires", sql(", r AS (SELECT *, row_number() OVER (PARTITION BY floor(lat / 0.05), floor(lon / 0.05) ORDER BY frp DESC, lat, lon, okey DESC, line DESC) AS rn FROM px) SELECT okey, line, lat, lon, frp FROM r WHERE rn = 1 OR (SELECT count(*) FROM px) <= 300 ORDER BY frp DESC, lat, lon LIMIT 300", "px"))
def t2(spark, sf_dir):
    return FI.thinned(pixels(spark, sf_dir).select("okey", "line", "lat", "lon", "frp"), 300)


@query("t3_top_ribbons", sql(f", {CL_SQL} SELECT cy, cx, round(frp_total, 6) AS frp_total, {_compass(_bear(str(T.TARGET[0]), str(T.TARGET[1]), 'lat', 'lon'))} AS point FROM k WHERE listed AND share >= 0.3 AND NOT (lat BETWEEN 28.2 AND 28.92 AND lon BETWEEN 76.8 AND 77.62) ORDER BY frp_total DESC, cy, cx LIMIT 6", "px"))
def t3(spark, sf_dir):
    s, n, w, e = T.NEAR_BOX
    c = FI.clusters(pixels(spark, sf_dir)).where(F.col("listed") & (F.col("share_pct") >= 0.3) & ~(F.col("lat").between(s, n) & F.col("lon").between(w, e)))
    top = c.orderBy(F.desc("frp_total"), "cy", "cx").limit(6)
    return top.select("cy", "cx", F.round("frp_total", 6).alias("frp_total"), G.compass(G.bearing_deg(*T.TARGET, F.col("lat"), F.col("lon"))).alias("point"))


@query("t8_route", sql(f", s AS (SELECT {STATE_SQL} AS state, max({_hav('lat', 'lon', *T.TARGET)}) AS km FROM px GROUP BY 1) SELECT array_to_string(list(state ORDER BY km DESC)[1:3], ' > ') || ' > Delhi' AS route FROM s WHERE state <> 'Delhi NCR'", "px"))
def t8(spark, sf_dir):
    km = G.haversine_km(F.col("lat"), F.col("lon"), *T.TARGET)
    far = pixels(spark, sf_dir).groupBy(G.rough_state(F.col("lat"), F.col("lon")).alias("state")).agg(F.max(km).alias("km")).where("state <> 'Delhi NCR'")
    top = far.agg(F.sort_array(F.collect_list(F.struct("km", "state")), False).alias("s"))  # seven states at most
    return top.select(F.concat(F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["state"]), " > "), F.lit(" > Delhi")).alias("route"))


@query(
    "a22_block_alerts",
    sql(f""", {GRID_SQL}, p AS MATERIALIZED (SELECT gy, gx, sum(frp * exp(-(pow((glon - lon) * 97.5::DOUBLE, 2) + pow((glat - lat) * 111.0::DOUBLE, 2)) / 4050)) * 0.22 AS frp FROM px, g GROUP BY gy, gx),
    c AS (SELECT gy, gx, frp, 1 / (1 + exp(1 - frp / (SELECT avg(frp) FROM p))) AS isi FROM p),
    i AS (SELECT gy // 7 AS bi, gx // 8 AS bj, avg(isi) AS isi, max(frp) AS frp, arg_max(gy, isi) AS top_gy, arg_max(gx, isi) AS top_gx FROM c WHERE (gy // 7) * 7 < 63 AND (gx // 8) * 8 < 72 GROUP BY 1, 2)
    SELECT bi::INTEGER AS bi, bj::INTEGER AS bj, round(isi, 6) AS isi, round(frp, 2) AS frp_max, top_gy::INTEGER AS top_gy, top_gx::INTEGER AS top_gx FROM i WHERE isi >= 0.5 ORDER BY bi, bj LIMIT 10""", "px"),
)
def a22(spark, sf_dir):
    """The index of a cell is relative to the mean fire load of all cells."""
    f = written(SP.plume(SP.grid(spark), pixels(spark, sf_dir).select("lat", "lon", "frp"), 3.0, -4.0), "plume")
    mean = f.agg(F.avg("frp").alias("mean"))
    f = f.join(F.broadcast(mean)).withColumn("isi", 1 / (1 + F.exp(1 - F.col("frp") / F.col("mean"))))  # one row
    b = SP.block_alerts(f, "isi", 0.5, extremes=[F.max("frp").alias("frp_max")])
    return b.select("bi", "bj", F.round("isi", 6).alias("isi"), F.round("frp_max", 2).alias("frp_max"), "top_gy", "top_gx")


_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || round(glon, 4) || ',' || round(glat, 4)
    || ']},"properties":{"station":' || id || ',"value":' || value || '}}'"""


@query(
    "k6_geojson_stride",
    sql(
        f""", {GRID_SQL}, {V}, n AS (SELECT gy, gx, glat, glon, id, row_number() OVER (PARTITION BY gy, gx
          ORDER BY sqrt(pow((lat - glat) * 111.0::DOUBLE, 2) + pow((lon - glon) * 97.5::DOUBLE, 2)), id) AS rn FROM g, st JOIN v USING (id) WHERE gy % 7 = 0 AND gx % 8 = 0)
        SELECT gy // 7 AS part, '{{"type":"FeatureCollection","features":[' || string_agg({_FEATURE}, ',' ORDER BY gx) || ']}}' AS collection
        FROM n JOIN v USING (id) WHERE rn = 1 GROUP BY gy // 7""",
        "st", "h_small",
    ),
)
def k6(spark, sf_dir):
    """The nearest reporting station's value at every seventh row and eighth column, a collection for each such row."""
    v = _snapshot(spark, sf_dir)
    known = stations(spark, sf_dir).join(v.select("id"), "id", "left_semi")
    some = SP.grid(spark).where("gy % 7 = 0 and gx % 8 = 0")
    near = SP.nearest_stations(some, known, k=1).join(v, "id").join(F.broadcast(some.select("gy", "gx", "lat", "lon")), ["gy", "gx"])  # 100 cells
    collection = G.feature_collection(["id", "value"], {"id": "station"}, order=["gx"])
    return near.groupBy((F.col("gy") / 7).cast("long").alias("part")).agg(collection.alias("collection"))


@query("s4_fire_csv", sql("SELECT count(*) AS pixels, round(sum(frp), 6) AS frp_total, count(*) FILTER (confidence = 'n') AS n FROM px WHERE line <> 3", "px"))
def s4(spark, sf_dir):
    """Rows whose coordinates or power can't be read go; text as it comes from a file of strings."""
    raw = pixels(spark, sf_dir).select(F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), F.when(F.col("line") == 3, "n/a").otherwise(F.col("frp").cast("string")).alias("frp"), F.upper("confidence").alias("confidence"))
    kept = raw.select(*[F.col(c).try_cast("double").alias(c) for c in ("latitude", "longitude", "frp")], F.nullif(F.trim(F.lower("confidence")), F.lit("")).alias("confidence")).na.drop(subset=["latitude", "longitude", "frp"])
    return kept.agg(F.count("*").alias("pixels"), F.round(F.sum("frp"), 6).alias("frp_total"), F.count_if(F.col("confidence") == "n").alias("n"))
