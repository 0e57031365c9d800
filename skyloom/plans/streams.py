"""Queries that run streams over dropped files to their end and read the tables they leave, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bridge import LARGE, SMALL, observations, read, sql, steady, steady_sql
from ..sources.scratch import scratch, written
from ..streaming import recorder as R
from .registry import Registry
from .series import h_small

REG = Registry()
query = REG.query


def dropped(rows: DataFrame, name: str, files: int = 4) -> str:
    """Writes rows as so many files for a file stream, dealt by a hash of all columns."""
    part = written(rows.repartition(files), name)
    return part.inputFiles()[0].rsplit("/", 1)[0]


def _latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of an aggregating stream, run to its end: its updates are kept with their batch."""
    spark = stream.sparkSession
    table = scratch(spark, "updates")
    write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(table)
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "at")).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.parquet(table).groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("t"))
    return last.select(*keys, *[F.col(f"t.{c}").alias(c) for c in rest])


POLLS = "polls AS (SELECT station_id, value < 300 AS valid, ts AS observed_at, parameter AS pollutant, CASE WHEN event_id % 3 > 0 THEN value END AS concentration, floor(value)::INTEGER AS sub_index, event_id AS seq FROM obs), rec AS (SELECT station_id, pollutant, date_trunc('hour', observed_at) AS hour, coalesce(concentration, sub_index) AS value, CASE WHEN concentration IS NOT NULL THEN 'ugm3' ELSE 'subindex' END AS unit, seq FROM polls WHERE valid AND pollutant IN ('pm25', 'pm10', 'o3'))"


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir, SMALL)
    return o.select("station_id", (F.col("value") < 300).alias("valid"), F.col("ts").alias("observed_at"), F.col("parameter").alias("pollutant"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("concentration"), F.floor("value").cast("int").alias("sub_index"), F.col("event_id").alias("seq"))


@query("r1_recorder", sql(f", {POLLS} SELECT station_id, pollutant, hour, unit, arg_max(value, seq) AS value, max(seq) AS seq FROM rec GROUP BY ALL", "obs"))
def r1(spark, sf_dir):
    p = polls(spark, sf_dir)
    table = scratch(spark, "live-history")
    R.record(R.snapshots(spark, dropped(p, "polls"), p.schema.simpleString()[7:-1].replace(":", " ")), table, scratch(spark, "at")).awaitTermination()
    return R.current(spark, table).select("station_id", "pollutant", "hour", "unit", "value", "seq")


@query("r3_tumbling_hours", sql(f"SELECT station_id, parameter, date_trunc('hour', ts) AS hour, {steady_sql('avg(value)')} AS value, count(*) AS n FROM obs GROUP BY ALL", "obs"))
def r3(spark, sf_dir):
    o = observations(spark, sf_dir, SMALL).select("station_id", "parameter", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = R.tumbling(R.snapshots(spark, dropped(o, "events", 2), "station_id long, parameter string, ts timestamp, value double", 2))
    last = _latest(s, ["station_id", "parameter", "hour"])
    return last.select("station_id", "parameter", F.col("hour").cast("timestamp_ntz").alias("hour"), steady(F.col("value")).alias("value"), "n")


@query("r4_sliding_days", sql(f", w AS (SELECT station_id, parameter, value, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until FROM obs_large) SELECT station_id, parameter, until, {steady_sql('avg(value)')} AS value, count(*) AS n FROM w GROUP BY ALL", "obs_large"))
def r4(spark, sf_dir):
    o = observations(spark, sf_dir, LARGE).select("station_id", "parameter", F.col("ts").cast("timestamp").alias("ts"), "value")
    stream = R.hourly_sums(R.snapshots(spark, dropped(o, "days", 2), "station_id long, parameter string, ts timestamp, value double", 2))
    return R.sliding(_latest(stream, ["station_id", "parameter", "hour"])).select("station_id", "parameter", F.col("until").cast("timestamp_ntz").alias("until"), steady(F.col("value")).alias("value"), "n")


@query("r5_scheduled_ingest", "SELECT o_custkey AS key, count(*) - 1 AS skipped FROM orders GROUP BY 1")
def r5(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    table = scratch(spark, "ingested")
    R.ingest(R.snapshots(spark, dropped(o, "orders", 3), "key long, seq long"), table, scratch(spark, "at"), ["key"], "seq", "key long, seq long").awaitTermination()
    there = R.stored(spark, table, "key long, seq long").groupBy("key").agg(F.count("*").alias("kept"))
    return o.groupBy("key").agg(F.count("*").alias("all")).join(there, "key").select("key", (F.col("all") - F.col("kept")).alias("skipped"))


@query("k5_stream_retention", sql(f", {POLLS}, c AS (SELECT station_id, pollutant, hour, unit, arg_max(value, seq) AS value FROM rec GROUP BY ALL) SELECT station_id, pollutant, hour, unit, value FROM c WHERE hour >= (SELECT max(hour) FROM c) - INTERVAL 10 DAY", "obs"))
def k5(spark, sf_dir):
    p = polls(spark, sf_dir)
    table, target = scratch(spark, "live-history"), scratch(spark, "kept")
    R.record(R.snapshots(spark, dropped(p, "polls", 2), p.schema.simpleString()[7:-1].replace(":", " ")), table, scratch(spark, "at")).awaitTermination()
    R.compacted(spark, table, target, 10)
    return spark.read.parquet(target).select("station_id", "pollutant", "hour", "unit", "value")


@query("r6_step_means", sql(f"SELECT event_id % 72 AS lead, {steady_sql('avg(value)')} AS mean, count(*) AS n FROM obs GROUP BY 1", "obs"))
def r6(spark, sf_dir):
    o = observations(spark, sf_dir, SMALL).select((F.col("event_id") % 72).alias("lead"), "value")
    stream = R.step_means(R.snapshots(spark, dropped(o, "steps", 3), "lead long, value double"))
    return _latest(stream, ["lead"]).select("lead", steady(F.col("mean")).alias("mean"), "n")


def rocks(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_KEPT = "station_id, pollutant, unit, hour"


@query(
    "k5_stream_state",
    sql(
        f""", {POLLS}, c AS (SELECT {_KEPT}, arg_max(value, (seq, value)) AS value FROM rec GROUP BY ALL)
        SELECT {_KEPT}, value FROM c WHERE hour >= (SELECT max(hour) FROM c) - INTERVAL 10 DAY""",
        "obs",
    ),
)
def k5_state(spark, sf_dir):
    """The table of the newest ten days as keyed state of a stream: late polls overwrite, old hours leave by timers."""
    rocks(spark)
    p = polls(spark, sf_dir)
    schema = p.schema.simpleString()[7:-1].replace(":", " ")
    changes = R.retained_stream(R.readings(R.snapshots(spark, dropped(p, "polls", 3), schema)), 10)
    table = scratch(spark, "changes")
    write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(table)
    changes.writeStream.foreachBatch(write).option("checkpointLocation", scratch(spark, "at")).trigger(availableNow=True).start().awaitTermination()
    keys = _KEPT.split(", ")
    last = spark.read.parquet(table).groupBy(*keys).agg(F.max(F.struct("batch", "gone", "seq", "value")).alias("t"))
    return last.where("not t.gone").select(*keys[:-1], F.col("hour").cast("timestamp_ntz").alias("hour"), "t.value")


def by_time(rows: DataFrame, name: str, days: int = 10, hours_late: int = 20) -> str:
    """Writes rows (station_id, ts, value) for a file stream in slices of time, one after another, each shuffled over
    several files; some rows come up to so many hours late, in the next slice. A last row, of no station and of null value, stands
    two days behind all others, so that the watermark passes them."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    late = F.pmod(F.xxhash64("station_id", "ts"), F.lit(hours_late)) * 3600
    slot = F.floor((F.unix_seconds("ts") + late) / (days * 86400))
    kept = written(rows.withColumn("slot", slot), "slices")
    for r in kept.select("slot").distinct().orderBy("slot").collect():  # a slice for so many days
        kept.where(F.col("slot") == r["slot"]).drop("slot").repartition(4).write.mode("append").parquet(path)
    end = kept.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    end.select(F.lit(-1).cast("long").alias("station_id"), "ts", F.lit(None).cast("double").alias("value")).write.mode("append").parquet(path)
    return path


@query(
    "r8_stuck_online",
    sql(
        """, q AS (SELECT station_id, hour, round(value / 10) * 10 AS value FROM h_small),
        b AS (SELECT *, CASE WHEN value = lag(value) OVER w AND hour = lag(hour) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY station_id ORDER BY hour)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY station_id ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM b),
        n AS (SELECT *, count(*) OVER (PARTITION BY station_id, run) AS len FROM i)
        SELECT station_id, hour, value FROM n WHERE len >= 3 AND value < 100""",
        "h_small",
    ),
)
def r8(spark, sf_dir):
    """The stuck readings of a stream in slices of time, shuffled, with late rows: those that W9 would drop."""
    rocks(spark)
    rows = h_small(spark, sf_dir).select("station_id", F.col("hour").cast("timestamp").alias("ts"), (F.round(F.col("value") / 10) * 10).alias("value"))
    path = by_time(rows, "rows")
    stream = R.stuck(R.snapshots(spark, path, "station_id long, ts timestamp, value double", 4), 3, 100.0)
    out = scratch(spark, "stuck")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "at")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("station_id long, ts timestamp, value double").parquet(out)
    return found.select("station_id", F.col("ts").cast("timestamp_ntz").alias("hour"), "value")
