"""Queries of joins, roll-ups, sorting, sets, stores and forecasts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import index as X
from ..functions import weather as W
from ..operators import forecast as FC
from ..operators import rollup as R
from ..operators import store as ST
from ..operators import timeseries as S
from ..operators.selection import ranked_by_hash
from ..sources.bridge import LARGE, SMALL, observations, read, readings, sql, stations, steady, steady_sql
from ..sources.scratch import scratch, written
from .expressions import CATEGORY_SQL
from .registry import Registry
from .series import A2_SQL, D8, h_small, hp, mesh

REG = Registry()
query = REG.query
K = ["station_id"]
FC_SQL = "fc AS (SELECT station_id, hour, round(value * 0.6 + extract(hour FROM hour) + CASE WHEN station_id = 7 THEN NULL ELSE 0 END, 6) AS model FROM h_small WHERE extract(hour FROM hour) % 11 <> 3)"


def model(spark, sf_dir) -> DataFrame:
    h = h_small(spark, sf_dir).where("hour(hour) % 11 <> 3")
    return h.select("station_id", "hour", F.round(F.col("value") * 0.6 + F.hour("hour") + F.when(F.col("station_id") == 7, F.lit(None)).otherwise(0), 6).alias("model"))


@query("j1_left_join", sql(f", {FC_SQL} SELECT station_id, hour, value, model FROM h_small LEFT JOIN fc USING (station_id, hour)", "h_small"))
def j1(spark, sf_dir):
    return h_small(spark, sf_dir).join(model(spark, sf_dir), ["station_id", "hour"], "left")


@query("j2_full_join", sql(f", {FC_SQL}, late AS (SELECT station_id, hour + INTERVAL 3 HOUR AS hour, model FROM fc) SELECT station_id, hour, value, model FROM h_small FULL JOIN late USING (station_id, hour)", "h_small"))
def j2(spark, sf_dir):
    late = model(spark, sf_dir).withColumn("hour", F.col("hour") + F.expr("interval 3 hours"))
    return h_small(spark, sf_dir).join(late, ["station_id", "hour"], "outer")


@query("j3_semi_joins", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT user_id FROM events)")
def j3(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left_semi").join(e, "id", "left_semi")


@query("j4_latest_per_key", "SELECT o_orderkey AS id, o_custkey AS key, o_orderdate AS ts FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey)")
def j4(spark, sf_dir):
    return R.newest(readings(spark, sf_dir).select("id", "key", "ts"), ["key"], "ts")


def dense(spark, sf_dir) -> DataFrame:
    d = S.densify(h_small(spark, sf_dir), K).withColumnRenamed("value", "obs")
    return d.join(model(spark, sf_dir), ["station_id", "hour"], "left")


N_SQL = f"{FC_SQL}, {D8}, n AS MATERIALIZED (SELECT station_id, hour, value AS obs, model, extract(hour FROM hour + INTERVAL 330 MINUTE) AS lh FROM d LEFT JOIN fc USING (station_id, hour)), tr AS (SELECT * FROM n WHERE hour <= TIMESTAMP '2024-01-15')"
FIT_SQL = "wh AS (SELECT coalesce(sum(obs) FILTER (model > 0) / sum(model) FILTER (obs IS NOT NULL AND model > 0), 1) AS scale FROM tr), bh AS (SELECT lh, avg(obs) AS clim, sum(obs) FILTER (model > 0) / sum(model) FILTER (obs IS NOT NULL AND model > 0) AS hs FROM tr GROUP BY lh)"


def fitted(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dense series beside the model's, written once for all that looks at it, and its corrections."""
    d = written(dense(spark, sf_dir), "dense")
    return (d, *FC.corrections(d.where("hour <= timestamp_ntz'2024-01-15'")))


@query("a12_scale", sql(f", {N_SQL}, {FIT_SQL} SELECT {steady_sql('scale', 9)} AS scale FROM wh", "h_small"))
def a12(spark, sf_dir):
    return fitted(spark, sf_dir)[1].select(steady(F.col("scale"), 9).alias("scale"))


@query("a13_climatology", sql(f", {N_SQL}, {FIT_SQL} SELECT lh::INTEGER AS local_hour, {steady_sql('clim')} AS climatology, {steady_sql('hs')} AS hour_scale FROM bh", "h_small"))
def a13(spark, sf_dir):
    return fitted(spark, sf_dir)[2].select("local_hour", steady(F.col("climatology")).alias("climatology"), steady(F.col("hour_scale")).alias("hour_scale"))


F2_SQL = f"""{N_SQL}, {FIT_SQL}, e AS (SELECT station_id, greatest(TIMESTAMP '2024-01-15', min(hour) + INTERVAL 24 HOUR) AS lo, max(hour) - INTERVAL 72 HOUR AS hi FROM n GROUP BY station_id),
    o AS (SELECT station_id, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS origin FROM e WHERE lo <= hi), p AS (SELECT o.*, n.obs AS persistence FROM o JOIN n ON n.station_id = o.station_id AND n.hour = o.origin AND n.obs IS NOT NULL),
    l AS (SELECT p.*, unnest(generate_series(1, 72)) AS lead FROM p), s AS MATERIALIZED (SELECT l.station_id, l.origin, l.lead, t.obs AS truth, l.persistence, y.obs AS diurnal_persistence, bh.clim AS climatology, t.model AS raw, t.model * wh.scale AS scaled, t.model * coalesce(bh.hs, wh.scale) AS scaled_hourly,
    CASE WHEN l.lead <= 6 THEN l.persistence ELSE y.obs END AS blend_persist_diurnal, (y.obs + t.model * wh.scale) / 2 AS blend_diurnal_scaled
    FROM l JOIN n t ON t.station_id = l.station_id AND t.hour = l.origin + to_hours(l.lead) AND t.obs IS NOT NULL LEFT JOIN n y ON y.station_id = l.station_id AND y.hour = l.origin + to_hours(l.lead - 24) LEFT JOIN bh ON bh.lh = t.lh, wh)"""


def backtest(spark, sf_dir) -> DataFrame:
    d, whole, by = fitted(spark, sf_dir)
    return FC.samples(d, "station_id", whole, by, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("f2_backtest_samples", sql(f", {F2_SQL} SELECT station_id, origin, lead::INTEGER AS lead, truth, {', '.join(f'{steady_sql(m)} AS {m}' for m in FC.METHODS)} FROM s", "h_small"))
def f2(spark, sf_dir):
    return backtest(spark, sf_dir).select("station_id", "origin", "lead", "truth", *[steady(F.col(m)).alias(m) for m in FC.METHODS])


_LONG = ", u AS (" + " UNION ALL ".join(f"SELECT lead, truth, '{m}' AS method, {m} AS guess FROM s WHERE {m} IS NOT NULL" for m in FC.METHODS) + ")"
_ERR = f"count(*) AS n, {steady_sql('sqrt(avg((guess - truth) * (guess - truth)))')} AS rmse, {steady_sql('avg(abs(guess - truth))')} AS mae, {steady_sql('avg(guess - truth)')} AS bias"


def _err(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[steady(F.col(c)).alias(c) for c in ("rmse", "mae", "bias")])


@query("a14_scores", sql(f", {F2_SQL}{_LONG} SELECT method, {_ERR} FROM u GROUP BY method", "h_small"))
def a14(spark, sf_dir):
    return _err(R.errors(backtest(spark, sf_dir), FC.METHODS), "method")


_BUCKET = "CASE WHEN lead <= 6 THEN '+1-6h' WHEN lead <= 24 THEN '+7-24h' WHEN lead <= 48 THEN '+25-48h' ELSE '+49-72h' END"


@query("a15_scores_by_lead", sql(f", {F2_SQL}{_LONG} SELECT {_BUCKET} AS bucket, method, {_ERR} FROM u GROUP BY 1, 2", "h_small"))
def a15(spark, sf_dir):
    return _err(R.errors(backtest(spark, sf_dir).withColumn("bucket", F.expr(_BUCKET)), FC.METHODS, by=["bucket"]), "bucket", "method")


@query("a16_correlation", sql(f", {F2_SQL} SELECT count(*) AS n, round(corr(scaled, truth), 9) AS corr FROM s WHERE scaled IS NOT NULL", "h_small"))
def a16(spark, sf_dir):
    s = backtest(spark, sf_dir).where("scaled is not null")
    return s.agg(F.count("*").alias("n"), F.round(F.corr("scaled", "truth"), 9).alias("corr"))


@query("a17_pooled_error", sql(f", {F2_SQL}, q AS (SELECT station_id, count(*) AS n, sqrt(avg((raw - truth) * (raw - truth))) AS r FROM s WHERE raw IS NOT NULL GROUP BY station_id) SELECT station_id % 2 AS band, count(*) AS stations, sum(n)::BIGINT AS n, {steady_sql('sqrt(sum(n * r * r) / sum(n))')} AS rmse FROM q GROUP BY 1", "h_small"))
def a17(spark, sf_dir):
    q = R.errors(backtest(spark, sf_dir), ["raw"], by=["station_id"])
    return q.groupBy((F.col("station_id") % 2).alias("band")).agg(F.count("*").alias("stations"), F.sum("n").alias("n"), steady(F.sqrt(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")) / F.sum("n"))).alias("rmse"))


def _f1(x: str, t: float) -> str:
    return f"round(2.0::DOUBLE * count(*) FILTER ({x} >= {t} AND truth >= {t}) / greatest(count(*) FILTER ({x} >= {t}) + count(*) FILTER (truth >= {t}), 1), 6)"


@query(
    "a18_verdict",
    sql(f""", {F2_SQL}, v AS (SELECT truth, diurnal_persistence AS b, scaled_hourly AS o FROM s WHERE diurnal_persistence IS NOT NULL AND scaled_hourly IS NOT NULL), w AS (SELECT *, (SELECT avg(o) / avg(b) FROM v) AS f FROM v)
    SELECT count(*) AS n, {steady_sql("sqrt(avg(pow(b - truth, 2)))")} AS base_rmse, {steady_sql("sqrt(avg(pow(b * f - truth, 2)))")} AS uniform_rmse, {steady_sql("avg(o - truth)")} AS other_bias, {_f1("b", 80)} AS base_f1_80, {_f1("b * f", 80)} AS uniform_f1_80, count(*) FILTER (truth >= 90) AS severe_n FROM w""", "h_small"),
)
def a18(spark, sf_dir):
    v = FC.verdict(backtest(spark, sf_dir), "diurnal_persistence", "scaled_hourly", thresholds=(80.0,), severe=90.0)
    return v.select("n", *[steady(F.col(c)).alias(c) for c in ("base_rmse", "uniform_rmse", "other_bias")], F.round("base_f1_80", 6).alias("base_f1_80"), F.round("uniform_f1_80", 6).alias("uniform_f1_80"), "severe_n")


@query(
    "f1_blend_forecast",
    sql(f""", {N_SQL}, {FIT_SQL}, q AS (SELECT hour, count(obs) / 8.0::DOUBLE AS share FROM n GROUP BY hour), og AS (SELECT max(hour) - INTERVAL 96 HOUR AS origin FROM n), sx AS (SELECT DISTINCT station_id FROM n), ll AS (SELECT station_id, unnest(generate_series(1, 72)) AS lead FROM sx),
    lx AS (SELECT ll.*, origin + to_hours(lead) AS hour FROM ll, og), j AS (SELECT lx.station_id, lx.lead, lx.hour, t.model * wh.scale AS m, q.share >= 0.5 AS ok, CASE WHEN q.share >= 0.5 THEN y.obs END AS day FROM lx LEFT JOIN n t USING (station_id, hour) LEFT JOIN n y ON y.station_id = lx.station_id AND y.hour = lx.hour - INTERVAL 24 HOUR LEFT JOIN q ON q.hour = lx.hour - INTERVAL 24 HOUR, wh)
    SELECT station_id, lead::INTEGER AS lead, hour, {steady_sql("coalesce((day + m) / 2, day, m)")} AS value, CASE WHEN ok THEN 'blend' ELSE 'model_only' END AS method FROM j""", "h_small"),
)
def f1(spark, sf_dir):
    d, whole, _ = fitted(spark, sf_dir)
    shares = d.groupBy("hour").agg((F.count("obs") / 8.0).alias("share"))
    origin = d.agg((F.max("hour") - F.expr("interval 96 hours")).alias("origin"))
    b = FC.blend(d, d, "station_id", origin, whole, shares)
    return b.select("station_id", "lead", "hour", steady(F.col("value")).alias("value"), "method")


@query("a19_averages_mode", f"SELECT o_custkey AS key, {steady_sql('avg(o_totalprice)')} AS mean, (SELECT p.o_orderpriority FROM orders p WHERE p.o_custkey = o.o_custkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant, max(o_orderdate) AS last FROM orders o GROUP BY o_custkey")
def a19(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("key")).agg(steady(F.avg("o_totalprice")).alias("mean"), R.mode(F.col("o_orderpriority")).alias("dominant"), F.max("o_orderdate").alias("last"))


@query("a20_window_counts", "SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'Unknown') AS region, count(*) FILTER (ts > TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30') AS day, count(*) FILTER (ts > TIMESTAMP '2024-01-30' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-30') AS two_days, max(value) AS brightest, max(ts) AS last FROM events GROUP BY 1")
def a20(spark, sf_dir):
    now, ts = F.lit("2024-01-30").cast("timestamp_ntz"), F.col("ts")
    within = lambda h: F.count_if((ts > now - F.expr(f"interval {h} hours")) & (ts <= now))
    region = F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("Unknown")).alias("region")
    return read(spark, sf_dir, "events").groupBy(region).agg(within(24).alias("day"), within(48).alias("two_days"), F.max("value").alias("brightest"), F.max("ts").alias("last"))


@query("a21_table_health", "SELECT count(*) AS readings, count(DISTINCT user_id) AS stations, min(ts) AS oldest, max(ts) AS newest, date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 AS hours_span FROM events")
def a21(spark, sf_dir):
    e = read(spark, sf_dir, "events").agg(F.count("*").alias("readings"), F.countDistinct("user_id").alias("stations"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    hour = lambda c: F.unix_seconds(F.date_trunc("hour", c).cast("timestamp"))
    return e.withColumn("hours_span", ((hour("newest") - hour("oldest")) / 3600).cast("long") + 1)


@query("a23_district_frames", sql(f"SELECT hour, station_id % 4 AS district, {steady_sql('avg(value)')} AS pm25, count(*) AS cells FROM h_small GROUP BY ALL", "h_small"))
def a23(spark, sf_dir):
    return h_small(spark, sf_dir).groupBy("hour", (F.col("station_id") % 4).alias("district")).agg(steady(F.avg("value")).alias("pm25"), F.count("*").alias("cells"))


@query("a24_smoke_share", sql(", p AS (SELECT avg(value) FILTER (parameter = 'so2') AS s, avg(value) FILTER (parameter = 'pm25') AS t FROM obs) SELECT round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, s / 9 / t * 100)), 6) AS share_pct FROM p WHERE t > 0", "obs"))
def a24(spark, sf_dir):
    m = lambda p: F.avg(F.when(F.col("parameter") == p, F.col("value")))
    s = observations(spark, sf_dir, SMALL).agg(m("so2").alias("s"), m("pm25").alias("t")).where("t > 0")
    return s.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("s") / 9 / F.col("t") * 100)), 6).alias("share_pct"))


@query("a25_feedback_summary", sql("SELECT round(avg(a), 9) AS aod_mean, round(max(a), 9) AS aod_max, round(avg(-180 * (1 / (1 + exp(-a)) - 0.5)), 6) AS dimming_mean, round(min(-180 * (1 / (1 + exp(-a)) - 0.5)), 6) AS dimming_most FROM (SELECT least(3.5::DOUBLE, value * 0.007) AS a FROM obs)", "obs"))
def a25(spark, sf_dir):
    c = W.coupled(F.col("value"), F.lit(1000.0), F.lit(800.0), F.lit(20.0))
    d = observations(spark, sf_dir, SMALL).select(c["aod"].alias("a"), (c["solar_out"] - 1000).alias("d"))
    return d.agg(F.round(F.avg("a"), 9).alias("aod_mean"), F.round(F.max("a"), 9).alias("aod_max"), F.round(F.avg("d"), 6).alias("dimming_mean"), F.round(F.min("d"), 6).alias("dimming_most"))


@query("a26_flag_counts", "SELECT event_type AS field, count(*) AS n, count(*) FILTER (f <> 'ok' AND f <> 'no_window') AS flagged, count(*) FILTER (f = 'no_window') AS no_window, count(*) FILTER (k % 7 = 0) AS imputed FROM (SELECT event_type, k, CASE WHEN k % 5 = 0 THEN 'no_window' WHEN k % 3 = 0 THEN 'suspect' ELSE 'ok' END AS f FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1")
def a26(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("f", F.when(F.col("k") % 5 == 0, "no_window").when(F.col("k") % 3 == 0, "suspect").otherwise("ok"))
    return e.groupBy(F.col("event_type").alias("field")).agg(F.count("*").alias("n"), F.count_if(~F.col("f").isin("ok", "no_window")).alias("flagged"), F.count_if(F.col("f") == "no_window").alias("no_window"), F.count_if(F.col("k") % 7 == 0).alias("imputed"))


@query("a27_validation", "SELECT 'events' AS source, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) - count(DISTINCT (user_id, ts)) AS duplicates, count(*) FILTER (value < 0 OR value > 400) AS out_of_range FROM events UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_totalprice IS NULL), count(*) - count(DISTINCT (o_custkey, o_orderdate)), count(*) FILTER (o_totalprice > 400000) FROM orders")
def a27(spark, sf_dir):
    def issues(df, source, keys, value, low, high):
        n = df.groupBy(*keys).agg(F.count("*").alias("c"), F.count_if(F.col(value).isNull()).alias("z"), F.count_if((F.col(value) < low) | (F.col(value) > high)).alias("o"))
        return n.agg(F.sum("c").alias("n"), F.sum("z").alias("nulls"), F.sum(F.col("c") - 1).alias("duplicates"), F.sum("o").alias("out_of_range")).withColumn("source", F.lit(source))

    e = issues(read(spark, sf_dir, "events"), "events", ["user_id", "ts"], "value", 0, 400)
    return e.unionByName(issues(read(spark, sf_dir, "orders"), "orders", ["o_custkey", "o_orderdate"], "o_totalprice", -1, 400000))


@query("a28_channel_stats", sql("SELECT parameter, min(value) AS low, max(value) AS high, round(avg(value) + 1.37e-9, 6) AS mean, round(avg((value > 60)::INTEGER), 6) AS clipped FROM obs GROUP BY parameter", "obs"))
def a28(spark, sf_dir):
    return observations(spark, sf_dir, SMALL).groupBy("parameter").agg(F.min("value").alias("low"), F.max("value").alias("high"), steady(F.avg("value")).alias("mean"), F.round(F.avg((F.col("value") > 60).cast("int")), 6).alias("clipped"))


M_LAST = "ml AS (SELECT station_id, aqi, prominent, hour, CASE WHEN station_id % 2 = 0 THEN 'North' ELSE 'South' END AS zone FROM mesh WHERE valid)"


def indexed(spark, sf_dir) -> DataFrame:
    m = mesh(spark, sf_dir).where("valid")
    return m.withColumn("zone", F.when(F.col("station_id") % 2 == 0, "North").otherwise("South"))


@query("a30_city_now", sql(f"{A2_SQL}, {M_LAST} SELECT count(*) AS indexed, {steady_sql('avg(aqi)')} AS mean, max(aqi) AS worst, min(aqi) AS best FROM ml", "hp_large"))
def a30(spark, sf_dir):
    return indexed(spark, sf_dir).agg(F.count("*").alias("indexed"), steady(F.avg("aqi")).alias("mean"), F.max("aqi").alias("worst"), F.min("aqi").alias("best"))


@query("a31_history_summary", sql(", d AS (SELECT hour::DATE AS day, round(avg(value) + 1.37e-9, 6) AS v FROM h_small GROUP BY 1) SELECT round(avg(v) + 1.37e-9, 6) AS mean, arg_min(day, v) AS best, arg_max(day, v) AS worst FROM d", "h_small"))
def a31(spark, sf_dir):
    d = h_small(spark, sf_dir).groupBy(F.col("hour").cast("date").alias("day")).agg(steady(F.avg("value")).alias("v"))
    return d.agg(steady(F.avg("v")).alias("mean"), F.min(F.struct("v", "day"))["day"].alias("best"), F.max(F.struct("v", "day"))["day"].alias("worst"))


@query("a32_alert_counts", sql(f"{A2_SQL}, {M_LAST} SELECT zone, count(*) FILTER (aqi > 200) AS watch, count(*) FILTER (aqi > 100) AS moderate, max(aqi) AS worst FROM ml GROUP BY zone", "hp_large"))
def a32(spark, sf_dir):
    return indexed(spark, sf_dir).groupBy("zone").agg(F.count_if(F.col("aqi") > 200).alias("watch"), F.count_if(F.col("aqi") > 100).alias("moderate"), F.max("aqi").alias("worst"))


@query("a33_channel_coverage", sql("SELECT parameter, count(*) AS reporting, min(value) AS low, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM hp WHERE hour = (SELECT max(hour) FROM hp) GROUP BY parameter", "hp"))
def a33(spark, sf_dir):
    h = hp(spark, sf_dir, SMALL)
    now = h.join(F.broadcast(h.agg(F.max("hour").alias("hour"))), "hour")
    return now.groupBy("parameter").agg(F.count("*").alias("reporting"), F.min("value").alias("low"), R.upper_median("value").alias("upper_median"))


@query("a34_drivers", sql(f"{A2_SQL}, {M_LAST} SELECT prominent, count(*) FILTER (zone = 'North') AS \"North\", count(*) FILTER (zone = 'South') AS \"South\", round(count(*) * 100.0 / (SELECT count(*) FROM ml), 6) AS pct FROM ml GROUP BY prominent", "hp_large"))
def a34(spark, sf_dir):
    m = indexed(spark, sf_dir)
    p = m.groupBy("prominent").pivot("zone", ["North", "South"]).count().na.fill(0)
    total = m.agg(F.count("*").alias("all"))
    return p.join(F.broadcast(total)).select("prominent", "North", "South", F.round((F.col("North") + F.col("South")) * 100.0 / F.col("all"), 6).alias("pct"))


@query("a36_zone_summary", sql(f"{A2_SQL}, {M_LAST}, c AS (SELECT zone, prominent, count(*) AS n FROM ml GROUP BY ALL) SELECT zone, {steady_sql('avg(aqi)')} AS mean, count(*) AS n, (SELECT prominent FROM c WHERE c.zone = ml.zone ORDER BY n DESC, prominent LIMIT 1) AS dominant FROM ml GROUP BY zone", "hp_large"))
def a36(spark, sf_dir):
    return indexed(spark, sf_dir).groupBy("zone").agg(steady(F.avg("aqi")).alias("mean"), F.count("*").alias("n"), R.mode(F.col("prominent")).alias("dominant"))


@query("a37_city_hours", sql(f", z AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h_small), c AS (SELECT hour, avg(value) AS v FROM h_small GROUP BY hour) SELECT hour, {steady_sql('v')} AS value FROM z LEFT JOIN c USING (hour)", "h_small"))
def a37(spark, sf_dir):
    c = h_small(spark, sf_dir).groupBy("hour").agg(steady(F.avg("value")).alias("value")).withColumn("city", F.lit(1))
    return S.densify(c, ["city"]).select("hour", "value")


@query("a38_circular_mean", "SELECT user_id AS id, round(d - 360.0 * floor(d / 360.0), 4) AS bearing FROM (SELECT user_id, degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) + 360 AS d FROM events GROUP BY user_id)")
def a38(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(R.circular_mean(F.col("value")), 4).alias("bearing"))


@query("a39_sector_worst", sql("SELECT station_id % 4 AS sector, count(*) AS stations, max(value) AS worst, arg_max(station_id, value) AS station_id FROM h_small WHERE hour = (SELECT max(hour) FROM h_small) GROUP BY 1", "h_small"))
def a39(spark, sf_dir):
    h = h_small(spark, sf_dir)
    now = h.join(F.broadcast(h.agg(F.max("hour").alias("hour"))), "hour")
    t = now.groupBy((F.col("station_id") % 4).alias("sector")).agg(F.count("*").alias("stations"), F.max(F.struct("value", (-F.col("station_id")).alias("s"))).alias("t"))
    return t.select("sector", "stations", F.col("t.value").alias("worst"), (-F.col("t.s")).alias("station_id"))


@query("a41_stressor_shares", f"SELECT event_type AS stressor, {steady_sql('sum(value) / (SELECT sum(value) FROM events) * 100')} AS pct FROM events GROUP BY event_type")
def a41(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stressor")).agg(F.sum("value").alias("v"))
    return s.join(F.broadcast(s.agg(F.sum("v").alias("all")))).select("stressor", steady(F.col("v") / F.col("all") * 100).alias("pct"))


@query("a42_density_sweep", f"""WITH r AS (SELECT s_suppkey AS id, s_acctbal AS v, row_number() OVER (PARTITION BY t ORDER BY md5(t || '-' || s_suppkey)) AS rn, t FROM supplier, range(5) x(t)), n AS (SELECT count(*) AS n FROM supplier), f AS (SELECT unnest([0.75, 0.5, 0.25]) AS f),
    e AS (SELECT f, t, sqrt(avg(pow(v - k, 2))) AS rmse FROM (SELECT f, t, v, rn > round(n * f) AS held, avg(v) FILTER (rn <= round(n * f)) OVER (PARTITION BY f, t) AS k FROM r, n, f) WHERE held GROUP BY f, t)
    SELECT f::DOUBLE AS fraction, {steady_sql("avg(rmse)", 4)} AS rmse_mean, {steady_sql("stddev_pop(rmse)", 4)} AS rmse_sd FROM e GROUP BY f""")  # fmt: skip
def a42(spark, sf_dir):
    """Networks are thinned by a seeded hash order in place of a generator, five times each."""
    trials = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"), trials)
    s = s.withColumn("h", F.md5(F.concat(F.col("t").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string"))))
    s = ranked_by_hash(s, ["t"], "h", "s_suppkey", "rn").withColumn("f", F.explode(F.array(F.lit(0.75), F.lit(0.5), F.lit(0.25))))
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    s = s.join(F.broadcast(n)).withColumn("held", F.col("rn") > F.round(F.col("n") * F.col("f")))
    mean = s.where("not held").groupBy("f", "t").agg(F.avg("v").alias("k"))
    e = s.where("held").join(F.broadcast(mean), ["f", "t"]).groupBy("f", "t").agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("k"), F.lit(2)))).alias("rmse"))  # fifteen rows
    return e.groupBy(F.col("f").alias("fraction")).agg(steady(F.avg("rmse"), 4).alias("rmse_mean"), steady(F.stddev_pop("rmse"), 4).alias("rmse_sd"))


@query("a43_distinct_stations", "SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part")
def a43(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).distinct()


@query(
    "a44_series_by_key",
    sql("""SELECT station_id, parameter, date_trunc('day', ts) AS day, list(CASE WHEN event_id % 5 > 0 THEN value END ORDER BY event_id) AS series
    FROM obs_large WHERE parameter <> 'so2' GROUP BY ALL""", "obs_large"),
)
def a44(spark, sf_dir):
    """A list holds a day of a station's readings, whatever the size of the table."""
    o = observations(spark, sf_dir, LARGE).where("parameter <> 'so2'").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    slot = F.struct("event_id", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"))
    s = o.groupBy("station_id", "parameter", "day").agg(F.sort_array(F.collect_list(slot)).alias("s"))
    return s.select("station_id", "parameter", "day", F.transform("s", lambda x: x["value"]).alias("series"))


@query("a46_inversion_means", sql("SELECT inv AS inversion, v AS ventilation, CASE WHEN p < 300 AND w < 1.5 THEN 'CRITICAL' WHEN p < 500 AND w < 2.5 THEN 'HIGH' WHEN p < 800 OR w < 3.5 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM (SELECT p, w, p < 400 AND w < 2 AS inv, round_even(p * w, 2) AS v FROM (SELECT round(avg(value * 8), 6) AS p, round(avg(value / 25), 6) AS w FROM obs))", "obs"))
def a46(spark, sf_dir):
    m = observations(spark, sf_dir, SMALL).agg(F.round(F.avg(F.col("value") * 8), 6).alias("p"), F.round(F.avg(F.col("value") / 25), 6).alias("w"))
    return m.select(W.dispersion(F.col("p"), F.col("w")).alias("d")).select("d.*")


@query("a49_better_than_raw", sql(f", {F2_SQL}{_LONG}, r AS (SELECT method, sqrt(avg(pow(guess - truth, 2))) AS rmse FROM u GROUP BY method) SELECT a.method, {steady_sql('(b.rmse - a.rmse) / b.rmse * 100')} AS better_pct FROM r a, r b WHERE b.method = 'raw'", "h_small"))
def a49(spark, sf_dir):
    r = R.errors(backtest(spark, sf_dir), FC.METHODS).select("method", "rmse")
    raw = r.where("method = 'raw'").select(F.col("rmse").alias("b"))
    return r.join(F.broadcast(raw)).select("method", steady((F.col("b") - F.col("rmse")) / F.col("b") * 100).alias("better_pct"))


@query("a50_source_status", "SELECT 'events' AS source, count(*) AS n, max(ts) AS newest, count(*) > 0 AS available FROM events UNION ALL SELECT 'orders', count(*), max(o_orderdate), count(*) > 0 FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_shipdate), count(*) > 0 FROM lineitem")
def a50(spark, sf_dir):
    parts = [("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]
    rows = [read(spark, sf_dir, t).agg(F.count("*").alias("n"), F.max(c).alias("newest")).select(F.lit(t).alias("source"), "n", "newest", (F.col("n") > 0).alias("available")) for t, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("t1_page", "SELECT o_orderkey AS id, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def t1(spark, sf_dir):
    return readings(spark, sf_dir).select("id", "ts").orderBy(F.desc("ts"), "id").offset(20).limit(50)


@query("t4_worst_three", sql(f"{A2_SQL} SELECT station_id, hour, aqi FROM mesh WHERE valid ORDER BY aqi DESC, station_id, hour LIMIT 3", "hp_large"))
def t4(spark, sf_dir):
    return indexed(spark, sf_dir).orderBy(F.desc("aqi"), "station_id", "hour").limit(3).select("station_id", "hour", "aqi")


@query("t5_every_sixth", sql("SELECT station_id, hour, value FROM h_small WHERE extract(hour FROM hour) % 6 = 0", "h_small"))
def t5(spark, sf_dir):
    return h_small(spark, sf_dir).where(F.hour("hour") % 6 == 0)


@query("t6_qualified_names", "WITH r AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS agency FROM part), a AS (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM r), b AS (SELECT id, agency, CASE WHEN c > 1 AND agency IS NOT NULL THEN name || ' · ' || agency ELSE name END AS name FROM a), d AS (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM b) SELECT id, CASE WHEN c > 1 THEN name || ' · ' || id ELSE name END AS name FROM d")
def t6(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("agency"))
    return ST.qualified(p, "name", "agency", "id").select("id", "name")


@query("t9_lookup", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE lower(s_name) = 'supplier#000000007' OR s_name ILIKE '%0007%' ORDER BY lower(s_name) <> 'supplier#000000007', s_suppkey LIMIT 1")
def t9(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    exact = F.lower("name") == "supplier#000000007"
    return s.where(exact | F.col("name").ilike("%0007%")).orderBy(~exact, "id").limit(1)


@query("o1_union_all", "SELECT o_custkey AS key, o_orderdate AS ts FROM orders UNION ALL SELECT user_id, ts FROM events")
def o1(spark, sf_dir):
    return readings(spark, sf_dir).select("key", "ts").unionByName(read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"))


@query("o2_intersect", "SELECT c_custkey AS key FROM customer INTERSECT SELECT user_id FROM events")
def o2(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).intersect(read(spark, sf_dir, "events").select("user_id"))


@query("o3_missing_hours", sql(f", {D8} SELECT station_id, hour FROM d EXCEPT SELECT station_id, hour FROM h_small", "h_small"))
def o3(spark, sf_dir):
    h = h_small(spark, sf_dir)
    return S.densify(h, K).join(h, ["station_id", "hour"], "left_anti").select("station_id", "hour")


@query("o4_union_distinct", "SELECT o_custkey AS key FROM orders UNION SELECT user_id FROM events")
def o4(spark, sf_dir):
    return readings(spark, sf_dir).select("key").union(read(spark, sf_dir, "events").select("user_id")).distinct()


@query("o5_preferred_source", "SELECT s_suppkey AS id, s_acctbal AS value FROM supplier WHERE s_suppkey % 2 = 1")
def o5(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return ST.preferred([s.where("id < 3"), s.where("id % 2 = 1"), s], 4)


@query("o6_live_only", "SELECT event_id, value FROM events WHERE event_type = 'error' OR (SELECT count(*) FROM events WHERE event_type = 'error') = 0")
def o6(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    any_live = e.agg(F.coalesce(F.bool_or(F.col("event_type") == "error"), F.lit(False)).alias("any"))
    return e.join(F.broadcast(any_live)).where((F.col("event_type") == "error") | ~F.col("any")).select("event_id", "value")


@query("o8_split_mesh", sql(f"{A2_SQL} SELECT station_id, hour, CASE WHEN valid THEN 'indexed' WHEN n_pollutants > 0 THEN 'unindexed' ELSE 'dropped' END AS part FROM mesh", "hp_large"))
def o8(spark, sf_dir):
    return mesh(spark, sf_dir).select("station_id", "hour", F.when(F.col("valid"), "indexed").when(F.col("n_pollutants") > 0, "unindexed").otherwise("dropped").alias("part"))


@query("k2_insert_absent", "SELECT o_custkey AS key, min(o_orderdate) AS ts FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey")
def k2(spark, sf_dir):
    there = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    fresh, _ = ST.insert_absent(there, readings(spark, sf_dir).select("key", "ts", "id"), ["key"], "ts", "id")
    return fresh.select("key", "ts")


@query("k4_merge_keep_last", "WITH n AS (SELECT user_id AS key, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id) SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM n) UNION ALL SELECT key, v FROM n")
def k4(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value", "ts", "event_id")
    return ST.upsert(old, new, ["key"], "ts", "event_id")


@query("k5_retained", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 12 DAY")
def k5(spark, sf_dir):
    return ST.retained(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit("2024-01-30 00:30:00").cast("timestamp_ntz"), 12)


@query("k11_migrated", "SELECT s_suppkey AS station_id, s_acctbal AS value, 'ugm3' AS unit FROM supplier")
def k11(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_acctbal").alias("value"), F.lit("ugm3").alias("unit"))


@query("f8_advisories", sql(f"{A2_SQL}, {M_LAST}, w AS (SELECT zone, max(aqi) AS a, count(*) AS n FROM ml GROUP BY zone) SELECT zone, CASE WHEN a > 300 THEN 'stage' WHEN a > 200 THEN 'watch' ELSE 'clear' END AS kind, a AS aqi, rank() OVER (ORDER BY a DESC, zone)::INTEGER AS place FROM w", "hp_large"))
def f8(spark, sf_dir):
    w = indexed(spark, sf_dir).groupBy("zone").agg(F.max("aqi").alias("aqi"))
    kind = F.when(F.col("aqi") > 300, "stage").when(F.col("aqi") > 200, "watch").otherwise("clear")
    return w.select("zone", kind.alias("kind"), "aqi", F.rank().over(Window.orderBy(F.desc("aqi"), "zone")).alias("place"))  # a row for each zone


@query("f9_narrative", sql(f"{A2_SQL}, {M_LAST} SELECT zone || ': index ' || max(aqi) || ' (' || {CATEGORY_SQL.format('max(aqi)')} || ') over ' || count(*) || ' hours' AS line FROM ml GROUP BY zone", "hp_large"))
def f9(spark, sf_dir):
    z = indexed(spark, sf_dir).groupBy("zone").agg(F.max("aqi").alias("a"), F.count("*").alias("n"))
    return z.select(F.format_string("%s: index %d (%s) over %d hours", "zone", "a", X.category(F.col("a")), "n").alias("line"))


@query("s2_pruned_scan", "SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE ts >= (SELECT date_trunc('hour', max(ts)) - INTERVAL 7 DAY FROM events) GROUP BY user_id")
def s2(spark, sf_dir):
    """The cutoff comes from a first pass over one column and reaches the scan as a literal."""
    e = read(spark, sf_dir, "events")
    cutoff = e.agg((F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz") - F.expr("interval 7 days")).alias("c")).first()["c"]
    return e.select("ts", "user_id", "value").where(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("s9_columnar_json", sql("SELECT station_id, hour, value FROM h_small", "h_small"))
def s9(spark, sf_dir):
    """Hourly values as parallel arrays in JSON files, a document for each station and day, read as files again."""
    path, day = scratch(spark, "hourly-json"), F.to_date("hour").alias("day")
    arrays = h_small(spark, sf_dir).groupBy("station_id", day).agg(F.sort_array(F.collect_list(F.struct("hour", "value"))).alias("r"))
    hourly = F.struct(F.transform("r", lambda x: x["hour"]).alias("time"), F.transform("r", lambda x: x["value"]).alias("value"))
    arrays.select("station_id", hourly.alias("hourly")).write.json(path)
    schema = "station_id long, hourly struct<time: array<timestamp_ntz>, value: array<double>>"
    back = spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]").json(path)
    return back.select("station_id", F.inline(F.arrays_zip("hourly.time", "hourly.value"))).toDF("station_id", "hour", "value")


@query("s10_cells_by_time", sql("SELECT hour AS valid_time, count(*) AS cells, list(value ORDER BY station_id) AS vals FROM h_small WHERE station_id IN (SELECT id FROM st WHERE lat BETWEEN 28.3 AND 28.7 AND lon BETWEEN 76.9 AND 77.4) GROUP BY hour", "st", "h_small"))
def s10(spark, sf_dir):
    """Cells inside a box, as lists by time: the box bounds a list."""
    inside = stations(spark, sf_dir).where("lat between 28.3 and 28.7 and lon between 76.9 and 77.4").select(F.col("id").alias("station_id"))
    h = h_small(spark, sf_dir).join(inside, "station_id", "left_semi")
    g = h.groupBy(F.col("hour").alias("valid_time")).agg(F.sort_array(F.collect_list(F.struct("station_id", "value"))).alias("r"))
    return g.select("valid_time", F.size("r").cast("long").alias("cells"), F.transform("r", lambda x: x["value"]).alias("vals"))


@query("s19_season_window", "SELECT year(o_orderdate) AS season, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n FROM orders WHERE o_orderdate >= make_date(year(o_orderdate), 10, 1) AND o_orderdate < make_date(year(o_orderdate), 12, 31) + INTERVAL 1 DAY GROUP BY 1")
def s19(spark, sf_dir):
    y = F.year("ts")
    r = readings(spark, sf_dir).where((F.col("ts") >= F.make_date(y, F.lit(10), F.lit(1))) & (F.col("ts") < F.date_add(F.make_date(y, F.lit(12), F.lit(31)), 1)))
    return r.groupBy(y.cast("long").alias("season")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
