"""Tables of the sensor-network model built from the star-schema tables, in Spark and (for the oracles) in SQL.

events stand for hourly observations, suppliers for stations, line items for fire pixels, orders for readings that
arrive by key. Hourly means are rounded to six digits, so that what follows doesn't depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: which event type stands for which pollutant ---
PARAMETERS = {"view": "pm25", "click": "pm10", "purchase": "no2", "signup": "o3", "error": "so2"}


#: Means of a few decimals often lie just between two rounded values; so little more puts them on one side.
NUDGE = 1.37e-9


def steady(x: Column, digits: int = 6) -> Column:
    """x rounded so that the order in which it was summed up doesn't show."""
    return F.round(x + NUDGE, digits)


def steady_sql(x: str, digits: int = 6) -> str:
    return f"round(({x}) + {NUDGE}::DOUBLE, {digits})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Users stand for sensors; so many of them make up a station. Stations grow in number with the sensors: small ones
#: are read about once an hour, large ones so often that each pollutant fills most hours of a day.
SMALL, LARGE = 12, 75


def observations(spark: SparkSession, sf_dir: str, sensors: int) -> DataFrame:
    """event_id, ts, station_id, sensor_id, parameter, value; a station is a group of so many sensors."""
    names = F.create_map(*[F.lit(x) for kv in PARAMETERS.items() for x in kv])
    return read(spark, sf_dir, "events").select("event_id", "ts", F.floor(F.col("user_id") / sensors).alias("station_id"), F.col("user_id").alias("sensor_id"), names[F.col("event_type")].alias("parameter"), "value")


def hourly(obs: DataFrame, *keys: str) -> DataFrame:
    """A1: the mean of each hour by keys."""
    return obs.groupBy(*keys, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.round(F.avg("value"), 6).alias("value"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, provider, lat, lon."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(  # nation has 25 rows
        k.alias("id"), F.concat("s_name", F.lit(", Delhi - "), F.when(k % 3 == 0, "DPCC").when(k % 3 == 1, "CPCB").otherwise("XYZ")).alias("name"), F.col("n_name").alias("provider"), (28.20 + (k * 37 % 70) / 100).alias("lat"), (76.80 + (k * 53 % 80) / 100).alias("lon")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire pixels, a line item each: okey, line, lat, lon, frp, acq_date, acq_time, satellite, confidence, kind, quantity."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), (27.0 + (F.col("l_partkey") % 550) / 100).alias("lat"), (74.0 + (F.col("l_orderkey") % 450) / 100).alias("lon"), (F.col("l_extendedprice") / 1000).alias("frp"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("acq_date"), (F.col("l_partkey") % 24 * 100 + F.col("l_suppkey") % 60).cast("string").alias("acq_time"), F.col("l_linestatus").alias("satellite"), F.lower("l_returnflag").alias("confidence"),
        F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber") - 1).alias("kind"), F.col("l_quantity").alias("quantity"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by key: id, key, ts, value, status."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))


def _obs(sensors: int) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARAMETERS.items())
    return f"SELECT event_id, ts, user_id // {sensors} AS station_id, user_id AS sensor_id, CASE event_type {names} END AS parameter, value FROM events"


#: Common table expressions of the oracles by name.
SQL = {
    "obs": _obs(SMALL),
    "obs_large": _obs(LARGE),
    "hp_large": f"SELECT station_id, parameter, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM ({_obs(LARGE)}) GROUP BY ALL",
    "hp": f"SELECT station_id, parameter, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM ({_obs(SMALL)}) GROUP BY ALL",
    "h_small": f"SELECT station_id, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM ({_obs(SMALL)}) GROUP BY ALL",
    "h_large": f"SELECT station_id, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM ({_obs(LARGE)}) GROUP BY ALL",
    "st": "SELECT s_suppkey AS id, s_name || ', Delhi - ' || CASE s_suppkey % 3 WHEN 0 THEN 'DPCC' WHEN 1 THEN 'CPCB' ELSE 'XYZ' END AS name, n_name AS provider, 28.20::DOUBLE + (s_suppkey * 37 % 70) / 100 AS lat, 76.80::DOUBLE + (s_suppkey * 53 % 80) / 100 AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "px": "SELECT l_orderkey AS okey, l_linenumber AS line, 27.0::DOUBLE + (l_partkey % 550) / 100 AS lat, 74.0::DOUBLE + (l_orderkey % 450) / 100 AS lon, l_extendedprice / 1000 AS frp, strftime(l_shipdate, '%Y-%m-%d') AS acq_date, (l_partkey % 24 * 100 + l_suppkey % 60)::VARCHAR AS acq_time, l_linestatus AS satellite, lower(l_returnflag) AS confidence, CASE WHEN l_linenumber <= 4 THEN l_linenumber - 1 END AS kind, l_quantity AS quantity FROM lineitem",
    "rd": "SELECT o_orderkey AS id, o_custkey AS key, o_orderdate AS ts, o_totalprice AS value, o_orderstatus AS status FROM orders",
}


def sql(body: str, *names: str) -> str:
    """body with the named table expressions in front; body may go on with further ones (", x AS (...) SELECT ...")."""
    head = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)
    body = body.strip()
    return f"WITH {head}{'' if body.startswith(',') else ' '}{body}" if head else body
