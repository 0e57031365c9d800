"""Queries of the window family W and of the index roll-ups, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import index as X
from ..functions import tables as T
from ..operators import rollup as R
from ..operators import timeseries as S
from ..sources.bridge import LARGE, SMALL, hourly, observations, read, sql, steady, steady_sql
from .expressions import CATEGORY_SQL, X3_SQL, index_by_sql, index_sql, ladder_sql
from .registry import Registry

REG = Registry()
query = REG.query
K = ["station_id"]
KP = ["station_id", "parameter"]


def h_small(spark, sf_dir) -> DataFrame:
    return hourly(observations(spark, sf_dir, SMALL), "station_id")


def h_large(spark, sf_dir) -> DataFrame:
    return hourly(observations(spark, sf_dir, LARGE), "station_id")


def hp(spark, sf_dir, m: int) -> DataFrame:
    return hourly(observations(spark, sf_dir, m), *KP)


def dense_sql(table: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"spine AS (SELECT {k}, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM {table} GROUP BY {k}), d AS MATERIALIZED (SELECT {k}, hour, value FROM spine LEFT JOIN {table} USING ({k}, hour))"


D8, D2, DP2 = dense_sql("h_small", "station_id"), dense_sql("h_large", "station_id"), dense_sql("hp_large", "station_id", "parameter")
WS = "PARTITION BY station_id ORDER BY hour"
WP = "PARTITION BY station_id, parameter ORDER BY hour"


@query("a1_hourly_mean", sql("SELECT station_id, parameter, hour, value FROM hp", "hp"))
def a1(spark, sf_dir):
    return hp(spark, sf_dir, SMALL)


@query("w1_densify", sql(f", {D8} SELECT * FROM d", "h_small"))
def w1(spark, sf_dir):
    return S.densify(h_small(spark, sf_dir), K)


@query("w2_trailing_mean", sql(f", {DP2} SELECT station_id, parameter, hour, {steady_sql('CASE WHEN count(value) OVER w >= 16 THEN avg(value) OVER w END')} AS mean24 FROM d WINDOW w AS ({WP} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", "hp_large"))
def w2(spark, sf_dir):
    d = S.densify(hp(spark, sf_dir, LARGE), KP)
    return d.select(*KP, "hour", steady(S.trailing_mean(F.col("value"), S.series(KP), 24, 16)).alias("mean24"))


EIGHT = f"e AS (SELECT *, CASE WHEN count(value) OVER w >= 6 THEN avg(value) OVER w END AS eight FROM d WINDOW w AS ({WP} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"
W3_SQL = f"{DP2}, {EIGHT}, g AS (SELECT station_id, parameter, hour, CASE WHEN parameter = 'o3' THEN max(eight) OVER w WHEN count(value) OVER w >= 16 THEN avg(value) OVER w END AS windowed FROM e WINDOW w AS ({WP} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"


@query("w3_index_window", sql(f", {W3_SQL} SELECT station_id, parameter, hour, {steady_sql('windowed')} AS windowed FROM g", "hp_large"))
def w3(spark, sf_dir):
    d = S.index_window(S.densify(hp(spark, sf_dir, LARGE), KP), KP, F.col("parameter") == "o3")
    return d.select(*KP, "hour", steady(F.col("windowed")).alias("windowed"))


@query(
    "w4_batch_window",
    sql(f""", {DP2}, {EIGHT} SELECT station_id, parameter, hour, count(value) OVER w AS n_valid, {steady_sql("CASE WHEN parameter = 'o3' THEN CASE WHEN count(value) OVER w >= 6 THEN max(eight) OVER v END WHEN count(value) OVER w >= 16 THEN avg(value) OVER w END")} AS windowed
    FROM e WINDOW w AS ({WP} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), v AS ({WP} ROWS BETWEEN 16 PRECEDING AND CURRENT ROW)""", "hp_large"),
)
def w4(spark, sf_dir):
    d = S.batch_window(S.densify(hp(spark, sf_dir, LARGE), KP), KP, F.col("parameter") == "o3")
    return d.select(*KP, "hour", "n_valid", steady(F.col("windowed")).alias("windowed"))


W5_SQL = f"{D8}, m AS (SELECT station_id, value, CASE WHEN count(*) OVER w = 24 THEN avg(value) OVER w END AS m FROM d WINDOW w AS ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)), worst AS (SELECT station_id, {steady_sql('coalesce(max(m), avg(value))')} AS worst FROM m GROUP BY station_id)"


@query("w5_worst_day", sql(f", {W5_SQL} SELECT * FROM worst", "h_small"))
def w5(spark, sf_dir):
    return S.worst_mean(S.densify(h_small(spark, sf_dir), K), K).select("station_id", steady(F.col("worst")).alias("worst"))


@query("w6_rolling_sub_index", sql(f", {D8}, m AS (SELECT station_id, hour, CASE WHEN count(*) OVER w = 24 THEN round(avg(value) OVER w, 6) END AS m FROM d WINDOW w AS ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT station_id, hour, {index_sql('pm25', 'm')} AS sub_index FROM m", "h_small"))
def w6(spark, sf_dir):
    w = S.series(K).rowsBetween(-23, 0)
    d = S.densify(h_small(spark, sf_dir), K).withColumn("m", F.when(F.count(F.lit(1)).over(w) == 24, F.round(F.avg("value").over(w), 6)))
    return d.select("station_id", "hour", X.sub_index("pm25", F.col("m")).alias("sub_index"))


@query("w7_fill", sql(f", {D8} SELECT station_id, hour, coalesce(last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM d WINDOW w AS ({WS})", "h_small"))
def w7(spark, sf_dir):
    return S.densify(h_small(spark, sf_dir), K).select("station_id", "hour", S.filled(F.col("value"), S.series(K), S.series(K, backwards=True)).alias("value"))


SPIKE_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY value DESC NULLS LAST) AS rn FROM {0}), s AS (SELECT hour, max(value) FILTER (rn = 2) AS second FROM r GROUP BY hour), c AS MATERIALIZED (SELECT station_id, hour, CASE WHEN value > 200 AND value > 3 * second THEN NULL ELSE value END AS value FROM {0} JOIN s USING (hour))"


@query("w8_despike", sql(f", {SPIKE_SQL.format('h_small')} SELECT * FROM c", "h_small"))
def w8(spark, sf_dir):
    return S.despike(h_small(spark, sf_dir)).select("station_id", "hour", "value")


@query(
    "w9_drop_stuck",
    sql(f""", {D2}, q AS (SELECT station_id, hour, round(value / 10) * 10 AS value FROM d), b AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS new FROM q WINDOW w AS ({WS})),
    i AS (SELECT *, sum(new) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS run FROM b), n AS (SELECT *, count(*) OVER (PARTITION BY station_id, run) AS len FROM i)
    SELECT station_id, hour, CASE WHEN len >= 3 AND value < 100 THEN NULL ELSE value END AS value FROM n""", "h_large"),
)
def w9(spark, sf_dir):
    d = S.densify(h_large(spark, sf_dir), K).withColumn("value", F.round(F.col("value") / 10) * 10)
    return S.drop_stuck(d, K, run=3, low=100.0).select("station_id", "hour", "value")


@query("w10_live_despike", sql(f", n AS (SELECT * FROM h_small WHERE hour = (SELECT max(hour) FROM h_small)), {SPIKE_SQL.format('n')} SELECT station_id, value FROM c", "h_small"))
def w10(spark, sf_dir):
    d = h_small(spark, sf_dir)
    now = d.join(F.broadcast(d.agg(F.max("hour").alias("hour"))), "hour")  # one row
    return S.despike(now).select("station_id", "value")


@query("w11_lag_day", sql(f", {D8} SELECT station_id, hour, lag(value, 24) OVER ({WS}) AS diurnal FROM d", "h_small"))
def w11(spark, sf_dir):
    return S.densify(h_small(spark, sf_dir), K).select("station_id", "hour", F.lag("value", 24).over(S.series(K)).alias("diurnal"))


GLOBAL_SQL = "hh AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h_small), d AS MATERIALIZED (SELECT s.station_id, hh.hour, h_small.value FROM hh CROSS JOIN (SELECT DISTINCT station_id FROM h_small) s LEFT JOIN h_small ON h_small.hour = hh.hour AND h_small.station_id = s.station_id)"


@query("w12_quorum", sql(f", {GLOBAL_SQL}, q AS (SELECT hour, avg((value IS NOT NULL)::INTEGER) AS share FROM d GROUP BY hour) SELECT hour, round(share, 6) AS share, hour = (SELECT max(hour) FROM q WHERE share >= 0.5) AS newest FROM q", "h_small"))
def w12(spark, sf_dir):
    q = S.quorum(S.densify(h_small(spark, sf_dir), K, whole=True))
    best = q.where("share >= 0.5").agg(F.max("hour").alias("best"))
    return q.join(F.broadcast(best)).select("hour", F.round("share", 6).alias("share"), (F.col("hour") == F.col("best")).alias("newest"))


_slots = ", e AS (SELECT max(hour) AS b FROM hp), g AS (SELECT station_id, parameter, {n} - 1 - date_diff('hour', hour, b) AS slot, value FROM hp, e WHERE hour <= b AND date_diff('hour', hour, b) < {n})"


@query(
    "w13_history_window",
    sql(_slots.format(n=48) + ", f AS (SELECT min(slot) AS a FROM g), k AS (SELECT DISTINCT station_id, parameter FROM g), z AS (SELECT k.*, unnest(generate_series(a, 47)) AS slot FROM k, f) SELECT station_id, parameter, list(value ORDER BY slot) AS window FROM z LEFT JOIN g USING (station_id, parameter, slot) GROUP BY station_id, parameter", "hp"),
)
def w13(spark, sf_dir):
    d = hp(spark, sf_dir, SMALL)
    d = d.join(F.broadcast(d.agg(F.max("hour").alias("end"))))  # one row
    return S.history(d, KP, F.col("end"), 48, trim=True)


@query("w14_last_day", sql(_slots.format(n=24) + ", k AS (SELECT DISTINCT station_id, parameter FROM g), z AS (SELECT k.*, unnest(generate_series(0, 23)) AS slot FROM k) SELECT station_id, parameter, list(value ORDER BY slot) AS window FROM z LEFT JOIN g USING (station_id, parameter, slot) GROUP BY station_id, parameter", "hp"))
def w14(spark, sf_dir):
    d = hp(spark, sf_dir, SMALL)
    return S.history(d.join(F.broadcast(d.agg(F.max("hour").alias("end")))), KP, F.col("end"), 24)


@query("w15_newest_sensor", sql("SELECT station_id, parameter, arg_max(sensor_id, (last, -sensor_id)) AS sensor_id, max(last) AS last FROM (SELECT station_id, parameter, sensor_id, max(ts) AS last FROM obs GROUP BY ALL) GROUP BY ALL", "obs"))
def w15(spark, sf_dir):
    s = observations(spark, sf_dir, SMALL).groupBy(*KP, "sensor_id").agg(F.max("ts").alias("last"))
    top = s.groupBy(*KP).agg(F.max(F.struct("last", (-F.col("sensor_id")).alias("s"))).alias("t"))
    return top.select(*KP, (-F.col("t.s")).alias("sensor_id"), F.col("t.last").alias("last"))


@query(
    "w16_interpolate",
    sql(f""", {D8}, n AS (SELECT station_id, hour, value, epoch(hour) AS t, last_value(CASE WHEN value IS NOT NULL THEN epoch(hour) END IGNORE NULLS) OVER a AS ta, last_value(value IGNORE NULLS) OVER a AS va,
    first_value(CASE WHEN value IS NOT NULL THEN epoch(hour) END IGNORE NULLS) OVER b AS tb, first_value(value IGNORE NULLS) OVER b AS vb FROM d WINDOW a AS ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT station_id, hour, {steady_sql('CASE WHEN value IS NOT NULL THEN value WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * (t - ta) / (tb - ta) ELSE coalesce(va, vb) END')} AS value FROM n""", "h_small"),
)
def w16(spark, sf_dir):
    return S.densify(h_small(spark, sf_dir), K).select("station_id", "hour", steady(S.interpolated(F.col("value"), F.col("hour"), S.series(K), S.series(K, backwards=True))).alias("value"))


@query("w17_worst_hour", sql("SELECT station_id, max(value) AS worst, min(hour) FILTER (value = m) AS hour FROM (SELECT *, max(value) OVER (PARTITION BY station_id) AS m FROM h_small) GROUP BY station_id", "h_small"))
def w17(spark, sf_dir):
    d = h_small(spark, sf_dir).withColumn("back", -F.unix_seconds(F.col("hour").cast("timestamp")))
    return d.groupBy("station_id").agg(F.max(F.struct("value", "back", "hour")).alias("t")).select("station_id", F.col("t.value").alias("worst"), "t.hour")


@query("w18_legal_windows", sql(", u AS (SELECT DISTINCT hour FROM hp_large WHERE parameter = 'pm25'), k AS (SELECT hour, epoch(hour) // 3600 - row_number() OVER (ORDER BY hour) AS k FROM u) SELECT min(hour) AS start, max(hour) AS \"end\", count(*) AS length, CASE WHEN count(*) >= 24 THEN (count(*) - 24) // 6 + 1 ELSE 0 END AS windows FROM k GROUP BY k", "hp_large"))
def w18(spark, sf_dir):
    b = S.blocks(hp(spark, sf_dir, LARGE).where("parameter = 'pm25'").select("hour").distinct())
    return b.select("start", "end", "length", S.windows_in(F.col("length"), 24, 6).alias("windows"))


@query("w20_rate_limit", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def w20(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-3600, 0)
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.count("*").over(w).alias("in_hour"))


A2_SQL = f""", {W3_SQL}, x AS (SELECT station_id, hour, parameter, {index_by_sql("parameter", "round(windowed, 6)")} AS sub, list_position(['pm25', 'pm10', 'no2', 'so2', 'nh3', 'pb', 'o3', 'co'], parameter) AS r FROM g),
    y AS (SELECT station_id, hour, count(sub) AS n, coalesce(bool_or(parameter IN ('pm25', 'pm10')) FILTER (sub IS NOT NULL), false) AS pm, max(sub) AS top, arg_max(parameter, sub * 100 - r) FILTER (sub IS NOT NULL) AS p FROM x GROUP BY station_id, hour),
    mesh AS MATERIALIZED (SELECT station_id, hour, n >= 3 AND pm AS valid, CASE WHEN n >= 3 AND pm THEN top END AS aqi, CASE WHEN n >= 3 AND pm THEN p END AS prominent, n::INTEGER AS n_pollutants,
    concat_ws('; ', CASE WHEN n < 3 THEN n || ' usable pollutant(s), 3 required' END, CASE WHEN NOT pm THEN 'neither PM2.5 nor PM10' END) AS reasons FROM y)"""


def mesh(spark, sf_dir) -> DataFrame:
    d = S.densify(hp(spark, sf_dir, LARGE), KP)
    w = S.index_window(d, KP, F.col("parameter") == "o3").withColumn("windowed", F.round("windowed", 6))
    return R.station_index(w, ["station_id", "hour"])


@query("a2_station_index", sql(f"{A2_SQL} SELECT station_id, hour, valid, aqi, {CATEGORY_SQL.format('aqi')} AS category, prominent, n_pollutants, reasons FROM mesh", "hp_large"))
def a2(spark, sf_dir):
    return mesh(spark, sf_dir)


@query(
    "a3_city_days",
    sql(f""", r AS (SELECT *, (hour + INTERVAL 330 MINUTE)::DATE AS day FROM h_small), p AS (SELECT day, station_id, avg(value) AS m, count(*) AS n FROM r GROUP BY ALL), u AS (SELECT day, count(DISTINCT hour) AS hours FROM r GROUP BY day),
    c AS (SELECT day, avg(m) AS pm25, sum(n) AS n, count(*)::INTEGER AS stations FROM p GROUP BY day), z AS (SELECT *, round_even(n / (hours * (SELECT count(DISTINCT station_id) FROM h_small)) * 100, 1) AS coverage_pct FROM c JOIN u USING (day))
    SELECT day, round(pm25, 6) AS pm25, {index_sql("pm25", "pm25")} AS aqi, {CATEGORY_SQL.format(index_sql("pm25", "pm25"))} AS band, stations, coverage_pct FROM z WHERE coverage_pct >= 20""", "h_small"),
)
def a3(spark, sf_dir):
    return R.city_days(h_small(spark, sf_dir))


@query("a4_coverage", sql(", e AS (SELECT max(hour) AS b FROM hp) SELECT station_id, parameter, count(*) AS hours, round(count(*) / 24.0, 6) AS share FROM hp, e WHERE hour > b - INTERVAL 24 HOUR GROUP BY station_id, parameter", "hp"))
def a4(spark, sf_dir):
    d = hp(spark, sf_dir, SMALL)
    last = d.join(F.broadcast(d.agg(F.max("hour").alias("b")))).where("hour > b - interval 24 hours")
    return last.groupBy(*KP).agg(F.count("*").alias("hours"), F.round(F.count("*") / 24.0, 6).alias("share"))


@query("a5_day_delta", sql(", e AS (SELECT max(hour) AS b FROM h_small), x AS (SELECT station_id, avg(value) FILTER (hour > b - INTERVAL 24 HOUR) AS now, avg(value) FILTER (hour <= b - INTERVAL 24 HOUR AND hour > b - INTERVAL 48 HOUR) AS prev FROM h_small, e GROUP BY station_id) SELECT station_id, round(CASE WHEN prev > 0 THEN (now - prev) / prev * 100 END, 6) AS delta_pct FROM x", "h_small"))
def a5(spark, sf_dir):
    d = h_small(spark, sf_dir)
    d = d.join(F.broadcast(d.agg(F.max("hour").alias("b"))))
    cut = F.col("b") - F.expr("interval 24 hours")
    now = F.avg(F.when(F.col("hour") > cut, F.col("value")))
    prev = F.avg(F.when((F.col("hour") <= cut) & (F.col("hour") > F.col("b") - F.expr("interval 48 hours")), F.col("value")))
    return d.groupBy("station_id").agg(now.alias("now"), prev.alias("prev")).select("station_id", F.round(F.when(F.col("prev") > 0, (F.col("now") - F.col("prev")) / F.col("prev") * 100), 6).alias("delta_pct"))


_stage = "CASE WHEN aqi <= 200 THEN 0 WHEN aqi <= 300 THEN 1 WHEN aqi <= 400 THEN 2 WHEN aqi <= 450 THEN 3 ELSE 4 END"


@query(
    "a6_policy_city",
    sql(f""", {W5_SQL}, w AS (SELECT {steady_sql('avg(worst) * 4')} AS pm25, max(worst) * 4 AS hot, arg_max(station_id, worst * 1000 - station_id) AS hot_id, count(*)::INTEGER AS stations FROM worst),
    c AS (SELECT *, round_even(pm25, 1) AS c FROM w), a AS (SELECT *, {X3_SQL.format("c", ladder_sql("c", T.POLICY_PM25))} AS aqi FROM c)
    SELECT pm25 AS city_pm25, aqi AS city_aqi, {_stage} AS stage, hot_id AS hotspot_id, round(hot, 4) AS hotspot_pm25, stations FROM a""", "h_small"),
)
def a6(spark, sf_dir):
    w = S.worst_mean(S.densify(h_small(spark, sf_dir), K), K).withColumn("worst", steady(F.col("worst")))
    top = F.max(F.struct("worst", (-F.col("station_id")).alias("s")))
    c = w.agg(steady(F.avg("worst") * 4).alias("city_pm25"), top.alias("t"), F.count("*").cast("int").alias("stations")).withColumn("city_aqi", X.policy_index(F.col("city_pm25")))
    return c.select("city_pm25", "city_aqi", X.policy_stage(F.col("city_aqi"))["stage"].alias("stage"), (-F.col("t.s")).alias("hotspot_id"), F.round(F.col("t.worst") * 4, 4).alias("hotspot_pm25"), "stations")


@query("a7_hourly_p95", sql("SELECT hour, round(quantile_cont(value, 0.95), 6) AS p95 FROM h_small GROUP BY hour", "h_small"))
def a7(spark, sf_dir):
    return h_small(spark, sf_dir).groupBy("hour").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))
