"""Structured Streaming jobs of the live network: recording, scheduled ingest, retention and online quality control.

Sinks write by key and are idempotent: a batch that is run again after a lost executor leaves the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import first_of, last_of

READING = "station_id long, pollutant string, hour timestamp_ntz, value double, unit string, seq long"
KEYS = ["station_id", "pollutant", "hour", "unit"]
RECORDED = ("pm25", "pm10", "o3")


def snapshots(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Polled snapshots dropped as Parquet files into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def readings(rows: DataFrame) -> DataFrame:
    """The recorded pollutants of valid stations at their own hour: a concentration, or else a sub-index under its own unit.

    rows: station_id, valid, observed_at, pollutant, concentration, sub_index, seq (the order of polls).
    """
    kept = rows.where(F.col("valid") & F.col("pollutant").isin(*RECORDED) & F.coalesce("concentration", "sub_index").isNotNull() & F.col("observed_at").isNotNull())
    unit = F.when(F.col("concentration").isNotNull(), "ugm3").otherwise("subindex")
    return kept.select("station_id", "pollutant", F.date_trunc("hour", "observed_at").cast("timestamp_ntz").alias("hour"), F.coalesce("concentration", F.col("sub_index").cast("double")).alias("value"), unit.alias("unit"), "seq")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to: made with the checkpoint's folder and lost with it, so that batch
    numbers, which begin anew with a new checkpoint, never meet those of an earlier one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/run")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        files.mkdirs(path)
        files.create(spark._jvm.org.apache.hadoop.fs.Path(path, uuid.uuid4().hex)).close()
    return min(x.getPath().getName() for x in files.listStatus(path))


def _replace(rows: DataFrame, table: str, *by: str) -> None:
    """Writes rows as partitions of the table; only partitions that rows have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)


def record(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's last reading a key to the log at ``table``; ``current`` reads the last one of all.

    A batch's file is named by run and batch: a batch that is run again replaces its own, and a new checkpoint leaves the
    log of earlier ones as it is, even where their source files are gone.
    """
    run = run_of(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        last = last_of(batch, KEYS, "seq").withColumns({"run": F.lit(run), "batch": F.lit(number)})
        _replace(last, table, "run", "batch")

    return readings(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """One row a key: the last reading by poll order, whatever order batches came in (R2: late data overwrites)."""
    log = spark.read.schema(f"{READING}, run string, batch int").parquet(table)
    return last_of(log, KEYS, "seq", "value", "run", "batch").drop("run", "batch")


def compacted(spark: SparkSession, table: str, target: str, newest_days: int = 30) -> None:
    """K5: ``current`` without hours more than so many days before the newest one, as a new table."""
    rows = current(spark, table)
    edge = rows.agg((F.max("hour") - F.expr(f"interval {newest_days} days")).alias("__edge"))
    rows.join(F.broadcast(edge)).where("hour >= __edge").drop("__edge").write.mode("overwrite").parquet(target)  # one row


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: str, schema: str, buckets: int = 64) -> StreamingQuery:
    """Insert-if-absent: the first row of each key stays.

    The table is partitioned by a hash of the key into so many buckets, and below by run and batch. A batch reads the keys of the
    buckets that its own keys fall into, and no others, and adds a file to some of these. One that is run again
    replaces its own files only. Choose as many buckets as keep one within what a batch may read.
    """
    run = run_of(stream.sparkSession, checkpoint)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = first_of(batch, keys, order).withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # ``buckets`` at most
        there = stored(spark, table, schema).where(F.col("bucket").isin(touched) & ~((F.col("run") == run) & (F.col("batch") == number)))
        fresh = rows.join(there.select(*keys), keys, "left_anti").withColumns({"run": F.lit(run), "batch": F.lit(number)})
        _replace(fresh, table, "bucket", "run", "batch")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The table that ``ingest`` keeps, with bucket, run and batch; without rows before its first batch."""
    whole = f"{schema}, bucket int, run string, batch int"
    return spark.read.schema(whole).parquet(table) if _exists(spark, table) else spark.createDataFrame([], whole)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def tumbling(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Hourly means by station and pollutant; readings later than ``late`` are let go with their state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "station_id", "parameter").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "station_id", "parameter", "value", "n")


def hourly_sums(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """R4's state: sum and count of each hour by station and pollutant. Windows that slide by the hour are sums of whole hours, so
    no window needs a state of its own."""
    hour = F.window("ts", "1 hour")
    sums = stream.withWatermark("ts", late).groupBy(hour, "station_id", "parameter").agg(F.sum("value").alias("total"), F.count("*").alias("rows"), F.count("value").alias("valued"))
    return sums.select(F.col("window.start").alias("hour"), "station_id", "parameter", "total", "rows", "valued")


def sliding(sums: DataFrame, hours: int = 24) -> DataFrame:
    """Means over sliding windows of so many hours, every hour, from the last state of ``hourly_sums``: a sorted pass over each
    station and pollutant, whose hours are followed by those without a reading that their windows still reach."""
    own = Window.partitionBy("station_id", "parameter").orderBy("__s")
    timed = sums.withColumn("__s", F.unix_seconds("hour"))
    empty = F.least(F.coalesce((F.lead("__s").over(own) - F.col("__s")) / 3600, F.lit(hours)).cast("int"), F.lit(hours)) - 1
    spread = timed.withColumn("__n", empty).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    only = lambda c: F.when(F.col("__k") == 0, F.col(c))
    dense = spread.select("station_id", "parameter", (F.col("__s") + F.col("__k") * 3600).alias("__s"), *[only(c).alias(c) for c in ("total", "rows", "valued")])
    frame = own.rangeBetween(-3600 * (hours - 1), 0)
    value = F.sum("total").over(frame) / F.nullif(F.sum("valued").over(frame), F.lit(0))
    return dense.select(F.timestamp_seconds(F.col("__s") + 3600).alias("until"), "station_id", "parameter", value.alias("value"), F.sum("rows").over(frame).alias("n"))


def step_means(stream: DataFrame) -> DataFrame:
    """Running means by lead, for update mode."""
    return stream.groupBy("lead").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


HOUR_MS = 3_600_000
_HELD = "at long, pollutants array<string>, units array<string>, hours array<long>, values array<double>, seqs array<long>"


class Retained(StatefulProcessor):
    """K5, R2 for one station: the last reading of each pollutant, unit and newest hour.

    The state is arrays with an entry for each hour that is kept, so days * 24 + 1 at most for each pollutant and unit, and one
    event-time timer, ``at``, for the oldest of them. It emits what an hour's reading has become, and once more, as ``gone``, when
    the hour is too old. Hours are milliseconds. What a call costs hardly depends on its rows, so a station has one for all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hours", _HELD)

    def _held(self) -> tuple[int | None, dict[tuple[str, str, int], tuple[float, int]]]:
        got = self.state.get()
        if got is None:
            return None, {}
        at, pollutants, units, hours, values, seqs = got
        return at, dict(zip(zip(pollutants, units, hours, strict=True), zip(values, seqs, strict=True), strict=True))

    def _keep(self, at: int | None, held: dict[tuple[str, str, int], tuple[float, int]]) -> None:
        wake = min(k[2] for k in held) - HOUR_MS + 1 if held else None
        if at is not None and at != wake:
            self.handle.deleteTimer(at)
        if wake is None:
            self.state.clear()
            return
        if at != wake:
            self.handle.registerTimer(wake)
        self.state.update((wake, *([k[i] for k in held] for i in range(3)), *([v[i] for v in held.values()] for i in range(2))))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        (at, held), changed = self._held(), {}
        for seq, value, *k in sorted((r.seq, r.value, r.pollutant, r.unit, r.ms) for r in rows):
            k = tuple(k)
            if k not in held or held[k][1] <= seq:
                held[k] = changed[k] = (value, seq)
        self._keep(at, held)
        for k, (value, seq) in changed.items():
            yield Row(station_id=key[0], pollutant=k[0], unit=k[1], hour=k[2], value=value, seq=seq, gone=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        edge, (_, held) = timerValues.getCurrentWatermarkInMs() + HOUR_MS, self._held()
        old = [k for k in held if k[2] < edge]
        for k in old:
            del held[k]
        self._keep(None, held)  # a timer that has expired is gone
        for k in old:
            yield Row(station_id=key[0], pollutant=k[0], unit=k[1], hour=k[2], value=None, seq=None, gone=True)

    def close(self) -> None:
        pass


def retained_stream(stream: DataFrame, days: int = 30) -> DataFrame:
    """K5, R2 as keyed state: changes (station_id, pollutant, unit, hour, value, seq, gone) of the table of the newest hours.

    stream: as ``readings`` gives it. A later poll overwrites an hour's reading as long as the hour is at most so many days before
    the newest hour of all (an hour more, for the watermark drops what equals it); older rows are dropped, and counted by
    Spark (numRowsDroppedByWatermark). Hours that have become too old leave the state by a timer. Needs the RocksDB store.
    """
    rows = stream.withColumn("hour", F.col("hour").cast("timestamp")).withColumn("ms", F.unix_millis("hour")).withWatermark("hour", f"{days * 24 + 1} hours")
    schema = "station_id long, pollutant string, unit string, hour long, value double, seq long, gone boolean"
    changes = rows.groupBy("station_id").transformWithState(Retained(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return changes.withColumn("hour", F.timestamp_millis("hour"))


class StuckSensor(StatefulProcessor):
    """Readings of runs of at least ``run`` equal low values, each no more than ``gap_ms`` after the one before.

    Readings wait in the state until the watermark has passed them, and are then looked at in the order of their time, so
    neither late rows nor batches break or join a run. The state is what waits, bounded by the watermark's delay, and the
    times of the present run, ``run`` at most.
    """

    def __init__(self, run: int = 6, low: float = 5.0, gap_ms: int = HOUR_MS):
        self.run, self.low, self.gap_ms = run, low, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "value double, length int, times array<long>, waiting array<long>, values array<double>")

    def _get(self) -> tuple[float | None, int, list[int], list[int], list[float]]:
        if not self.state.exists():
            return None, 0, [], [], []
        value, length, *lists = self.state.get()
        return value, length, *map(list, lists)

    def _wake(self, waiting: list[int]) -> None:
        if waiting and (at := min(waiting)) not in list(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        value, length, times, waiting, values = self._get()
        for r in pd.concat(list(rows)).dropna(subset=["ts", "value"]).itertuples():
            waiting.append(int(r.ts.timestamp() * 1000))
            values.append(float(r.value))
        self.state.update((value, length, times, waiting, values))
        self._wake(waiting)
        yield self._out(key, [])

    @staticmethod
    def _out(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=["station_id", "ts", "value", "length"])
        out["ts"] = pd.to_datetime(out["ts"], unit="ms")
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        value, length, times, waiting, values = self._get()
        pending = sorted(zip(waiting, values, strict=True))
        out = []
        for ts, v in (p for p in pending if p[0] <= passed):
            if not (v == value and ts - times[-1] <= self.gap_ms):
                value, length, times = v, 0, []
            length, times = length + 1, [*times, ts][-self.run :]
            if v < self.low and length >= self.run:
                out += [(t, v, length) for t in (times if length == self.run else times[-1:])]
        rest = [p for p in pending if p[0] > passed]
        self.state.update((value, length, times, [p[0] for p in rest], [p[1] for p in rest]))
        self._wake([p[0] for p in rest])
        yield self._out(key, out)

    def close(self) -> None:
        pass


def stuck(stream: DataFrame, run: int = 6, low: float = 5.0, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """R8 over a stream of station_id, ts, value: (station_id, ts, value, length), the same rows as W9 drops, each once the
    watermark has passed its run's last needed reading. Rows later than ``late`` are dropped. Needs the RocksDB store."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    keyed = stream.withWatermark("ts", late).groupBy("station_id")
    schema = "station_id long, ts timestamp, value double, length int"
    return keyed.transformWithStateInPandas(StuckSensor(run, low, gap_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
