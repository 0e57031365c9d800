"""Streams leave what a batch over the same rows gives, in any order and however often they run."""

import datetime as dt
import os
import random
import uuid

from pyspark.sql import functions as F

from skyloom.operators.store import last_of
from skyloom.streaming import recorder as R

POLLS = "station_id long, valid boolean, observed_at timestamp_ntz, pollutant string, concentration double, sub_index int, seq long"


def polls(spark, order):
    at = dt.datetime(2025, 11, 5, 7, 40)
    rows = [(1, True, at, "pm25", 80.0, 160, 1), (1, True, at + dt.timedelta(minutes=10), "pm25", 90.0, 170, 2), (1, True, at, "pm10", None, 120, 1), (2, False, at, "pm25", 70.0, 140, 1), (1, True, at, "no2", 5.0, 6, 1), (2, True, None, "o3", 5.0, 6, 2), (3, True, at, "o3", None, None, 2)]
    return spark.createDataFrame([rows[i] for i in order], POLLS)


def test_recording_is_idempotent_and_order_free(spark, tmp_path):
    results = []
    for order in ([0, 1, 2, 3, 4, 5, 6], [6, 1, 5, 0, 3, 4, 2]):
        src, table = str(tmp_path / uuid.uuid4().hex), str(tmp_path / uuid.uuid4().hex)
        for i in order:
            polls(spark, [i]).write.mode("append").parquet(src)
        for _ in range(2):  # the second run starts anew, as after a lost checkpoint
            R.record(R.snapshots(spark, src, POLLS), table, str(tmp_path / uuid.uuid4().hex)).awaitTermination()
        results.append(sorted(tuple(r) for r in R.current(spark, table).collect()))
    batch = sorted(tuple(r) for r in last_of(R.readings(polls(spark, range(7))), R.KEYS, "seq").collect())
    assert results[0] == results[1] == batch
    assert {(r[0], r[1], r[3], r[4]) for r in batch} == {(1, "pm25", 90.0, "ugm3"), (1, "pm10", 120.0, "subindex")}


def test_ingest_keeps_the_first(spark, tmp_path):
    src, table, at = (str(tmp_path / x) for x in ("src", "table", "at"))
    for rows in ([(1, 5), (1, 3)], [(1, 1), (2, 9)]):
        spark.createDataFrame(rows, "key long, seq long").coalesce(1).write.mode("append").parquet(src)
        R.ingest(R.snapshots(spark, src, "key long, seq long"), table, at, ["key"], "seq", "key long, seq long").awaitTermination()
    assert sorted((r["key"], r["seq"]) for r in R.stored(spark, table, "key long, seq long").collect()) == [(1, 3), (2, 9)]


def test_a_new_checkpoint_never_replaces_older_logs(spark, tmp_path):
    """The first run's source files are gone when the second one begins to number its batches at 0."""
    table = str(tmp_path / "table")
    for i in (0, 5):
        src, at = str(tmp_path / f"src{i}"), str(tmp_path / f"at{i}")
        polls(spark, [i]).withColumn("valid", F.lit(True)).withColumn("observed_at", F.lit("2025-11-05 07:40:00").cast("timestamp_ntz")).withColumn("concentration", F.lit(5.0)).write.parquet(src)
        R.record(R.snapshots(spark, src, POLLS), table, at).awaitTermination()
        again = R.run_of(spark, at)
        R.record(R.snapshots(spark, src, POLLS), table, at).awaitTermination()
        assert R.run_of(spark, at) == again
    assert sorted(r["station_id"] for r in R.current(spark, table).collect()) == [1, 2]
    assert spark.read.parquet(table).select("run").distinct().count() == 2


def test_ingest_reads_only_the_buckets_it_touches(spark, tmp_path):
    """A batch of one key leaves the other buckets' files unread: they may even be broken."""
    src, table, at = (str(tmp_path / x) for x in ("src", "table", "at"))
    schema = "key long, seq long"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        R.ingest(R.snapshots(spark, src, schema), table, at, ["key"], "seq", schema, buckets=8).awaitTermination()

    batch([(k, 1) for k in range(200)])
    there = {r["bucket"]: r["key"] for r in R.stored(spark, table, schema).collect()}
    assert len(there) == 8
    for bucket in list(there)[1:]:
        for path, _, names in os.walk(os.path.join(table, f"bucket={bucket}")):
            for name in names:
                if name.endswith(".parquet"):
                    with open(os.path.join(path, name), "wb") as f:
                        f.write(b"broken")
                elif name.endswith(".crc"):
                    os.remove(os.path.join(path, name))
    first = list(there)[0]
    batch([(there[first], 0), (there[first], 9)])
    kept = R.stored(spark, table, schema).where(F.col("bucket") == first).where(F.col("key") == there[first]).collect()
    assert [(r["key"], r["seq"]) for r in kept] == [(there[first], 1)]


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_out(stream, table, at):
    """Runs a stream to its end; each row is kept with its batch, and the progress of each batch is returned."""
    write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(table)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


T0 = dt.datetime(2025, 11, 5)
LIVE = "station_id long, pollutant string, hour timestamp_ntz, value double, unit string, seq long"


def test_retention_as_state(spark, tmp_path):
    """Late polls overwrite inside the days that are kept, whatever batch they come in; older ones are dropped and counted,
    and hours that have become too old leave the state."""
    rocks(spark)
    hour = lambda n: T0 + dt.timedelta(hours=n)
    row = lambda station, n, value, seq: (station, "pm25", hour(n), value, "ugm3", seq)
    batches = [
        [row(1, 0, 1.0, 1), row(1, 5, 5.0, 2), row(2, 1, 7.0, 3)],
        [row(1, 5, 6.0, 9), row(1, 5, 5.5, 8), row(1, 40, 4.0, 10)],
        [row(1, 5, 99.0, 11), row(1, 30, 3.0, 12), row(1, 16, 2.0, 13), row(2, 41, 8.0, 14)],
        [row(1, 41, 4.5, 15), row(1, 40, 3.9, 5), row(1, 2, 98.0, 16), row(2, 1, 97.0, 17)],
    ]
    src, table, at = (str(tmp_path / x) for x in ("src", "table", "at"))
    for rows in batches:
        spark.createDataFrame(rows, LIVE).coalesce(1).write.mode("append").parquet(src)
    progress = run_out(R.retained_stream(R.snapshots(spark, src, LIVE), 1), table, at)
    last = spark.read.parquet(table).groupBy("station_id", "hour").agg(F.max(F.struct("batch", "gone", "seq", "value")).alias("t"))
    got = {(r["station_id"], (r["hour"] - T0).total_seconds() / 3600): (r["t"]["value"], r["t"]["gone"]) for r in last.collect()}
    alive = {k: v for k, (v, gone) in got.items() if not gone}
    newest = 41
    assert alive == {(1, 30.0): 3.0, (1, 40.0): 4.0, (1, 41.0): 4.5, (2, 41.0): 8.0} and all(n >= newest - 24 for _, n in alive)
    assert got[1, 5.0] == (None, True) and got[1, 0.0] == (None, True) and got[2, 1.0] == (None, True)
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 2
    assert spark.read.parquet(table).where("value in (97, 98)").count() == 0
    assert (1, 16.0) not in alive


def stuck_plainly(rows, run, low, gap=1):
    """(station, hour) of runs of at least so many equal low values an hour apart."""
    out = set()
    for s in {r[0] for r in rows}:
        own, at = sorted((h, v) for t, h, v in rows if t == s), []
        for i, (h, v) in enumerate(own):
            at = [*at, h] if i and v == own[i - 1][1] and h - own[i - 1][0] <= gap else [h]
            if len(at) >= run and v < low:
                out |= {(s, x) for x in at}
    return out


def test_stuck_sensors_in_any_order(spark, tmp_path):
    """Late rows and borders between batches neither break nor join a run."""
    rocks(spark)
    rng = random.Random(12)
    rows = [(s, h, float(rng.choice([1, 1, 2, 50]))) for s in range(6) for h in range(90) if rng.random() < 0.93]
    want = stuck_plainly(rows, 3, 5.0)
    assert len(want) > 30
    # each row comes in the batch of its time or, up to 20 hours late, in the next one
    slot = lambda h: (h + rng.choice([0, 0, 5, 20])) // 30
    batches = {}
    for r in rows:
        batches.setdefault(slot(r[1]), []).append(r)
    src, table, at = (str(tmp_path / x) for x in ("src", "table", "at"))
    schema = "station_id long, ts timestamp, value double"
    for k in [*sorted(batches), None]:
        own = batches[k] if k is not None else [(-1, 200, None)]
        rng.shuffle(own)
        spark.createDataFrame([(s, T0 + dt.timedelta(hours=h), v) for s, h, v in own], schema).coalesce(1).write.mode("append").parquet(src)
    run_out(R.stuck(R.snapshots(spark, src, schema), 3, 5.0, late="22 hours"), table, at)
    got = [(r["station_id"], (r["ts"] - T0).total_seconds() / 3600) for r in spark.read.parquet(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sliding_windows_over_gaps(spark):
    """Windows that reach into hours without readings are there, those of nothing but such hours aren't; nulls count as rows only."""
    h = lambda n: T0 + dt.timedelta(hours=n)
    sums = [(1, "o3", 0, 5.0, 2, 1), (1, "o3", 2, 7.0, 1, 1), (1, "o3", 40, 3.0, 3, 3), (2, "o3", 1, None, 1, 0), (1, "no2", 1, 4.0, 1, 1)]
    df = spark.createDataFrame([(s, p, h(n), *rest) for s, p, n, *rest in sums], "station_id long, parameter string, hour timestamp, total double, rows long, valued long")
    want = {}
    for s, p, n, total, rows, valued in sums:
        for u in range(n + 1, n + 25):
            t, r, v = want.get((s, p, u), (0.0, 0, 0))
            want[s, p, u] = t + (total or 0), r + rows, v + valued
    out = R.sliding(df)
    got = {(r["station_id"], r["parameter"], (r["until"] - T0).total_seconds() / 3600): (r["value"], r["n"]) for r in out.collect()}
    assert got == {k: (t / v if v else None, r) for k, (t, r, v) in want.items()}
    assert "HashAggregate" not in out._jdf.queryExecution().toString()  # no window has an entry in a task's hash table


def test_a_station_holds_one_state(spark, tmp_path):
    """Pollutants and units of a station share its state and its timer, so calls don't multiply by them."""
    rocks(spark)
    rows = [(s, p, T0 + dt.timedelta(hours=n), float(n), u, n) for s in (1, 2) for p in ("pm25", "o3") for u in ("ugm3", "subindex") for n in (0, 3)]
    src, table, at = (str(tmp_path / x) for x in ("src", "table", "at"))
    spark.createDataFrame(rows, LIVE).coalesce(1).write.parquet(src)
    progress = run_out(R.retained_stream(R.snapshots(spark, src, LIVE), 1), table, at)
    got = spark.read.parquet(table)
    assert {(r["station_id"], r["pollutant"], r["hour"], r["value"], r["unit"], r["seq"]) for r in got.collect()} == set(rows)
    assert max(op["numRowsUpdated"] for p in progress for op in p["stateOperators"]) < 8, [op["numRowsUpdated"] for p in progress for op in p["stateOperators"]]
