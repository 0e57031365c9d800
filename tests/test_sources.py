"""Paged JSON, derived tables, training windows and scores by lead."""

import datetime as dt
import json
import math
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from skyloom.operators import rollup as R
from skyloom.operators import timeseries as S
from skyloom.sources import derived as D
from skyloom.sources.pages import Pages, names

RECORD = "id long, name string, value double, ok boolean"


def page(folder, name, *documents):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents))


def load(spark, path, **options):
    spark.dataSource.register(Pages)
    return spark.read.format("pages").options(**options).schema(RECORD).load(path)


def test_pages_are_read_side_by_side(spark, tmp_path):
    path = str(tmp_path / "pages")
    page(path, "b", {"page": 1, "records": [{"id": 1, "name": "é", "value": 2, "ok": True, "more": 9}, {"id": "7", "name": 5, "value": "x", "ok": "no"}, {"id": None}, 5]})
    page(path, "a", {"records": []}, "", {"records": [{"id": 2.0, "value": 1.5, "name": {"a": 1}}]})
    page(path, "c", "not json", {"other": 1}, {"records": 3}, {"records": [{"id": 3}]})
    page(path, "_hidden", {"records": [{"id": 99}]})
    page(path, ".part", {"records": [{"id": 99}]})
    page(path, "d.tmp", {"records": [{"id": 99}]})
    rows = load(spark, path)
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((tuple(r) for r in rows.collect()), key=str)
    assert got == sorted([(1, "é", 2.0, True), (7, "5", None, None), (None, None, None, None), (2, '{"a": 1}', 1.5, None), (3, None, None, None)], key=str)
    assert load(spark, f"file://{path}").count() == 5
    with pytest.raises(Exception, match="no document|no object"):
        load(spark, path, mode="FAILFAST").collect()
    assert load(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(Exception, match="schema"):
        spark.read.format("pages").load(path)


def test_a_stream_of_pages_goes_on_where_it_was_killed(spark, tmp_path):
    src, table, at = (str(tmp_path / x) for x in ("src", "table", "at"))
    spark.dataSource.register(Pages)

    def run(fail=None):
        def write(batch, number):
            if fail is not None and number == fail:
                raise RuntimeError("killed")
            batch.write.mode("append").parquet(table)

        q = spark.readStream.format("pages").schema(RECORD).load(src).writeStream.foreachBatch(write)
        q = q.option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()

    page(src, "000", {"records": [{"id": 0}, {"id": 1}]})
    page(src, "001", {"records": [{"id": 2}]})
    run()
    page(src, "002", {"records": [{"id": 3}]})
    with pytest.raises(Exception, match="killed"):
        run(fail=1)
    run()
    run()
    page(src, "003", {"records": [{"id": 4}]})
    run()
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [0, 1, 2, 3, 4]
    assert names(src) == ["000", "001", "002", "003"]


def test_a_derived_table_is_built_once_for_each_state_of_its_input(spark, tmp_path):
    root, source, built = str(tmp_path / "root"), str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("sum(id) AS s")

    ask = lambda **more: D.derived(spark, root, "sums", [source], build, **more).first()["s"]
    spark.range(5).coalesce(1).write.parquet(source)
    assert [ask(), ask()] == [10, 10] and len(built) == 1
    assert ask(parameters={"a": 1}) == 10 and len(built) == 2
    spark.range(5, 7).coalesce(1).write.mode("append").parquet(source)
    assert ask(stale=True) == 10  # the older one, at once
    D.settle()
    assert ask(stale=True) == 21 and ask() == 21 and len(built) == 3
    assert D.prune(spark, root, "sums", keep=1) == 1 and ask() == 21 and len(built) == 3
    assert D.derived(spark, root, "none", [str(tmp_path / "missing")], lambda: spark.range(3)).count() == 3


def test_two_writers_publish_one_whole_table(spark, tmp_path):
    root, source = str(tmp_path / "root"), str(tmp_path / "in")
    spark.range(100).write.parquet(source)
    gate, got = threading.Barrier(2), []

    def build():
        rows = spark.read.parquet(source)
        gate.wait(30)
        return rows

    def writer():
        got.append(D.derived(spark, root, "copy", [source], build).count())

    both = [threading.Thread(target=writer) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert got == [100, 100]
    assert D.derived(spark, root, "copy", [source], lambda: 1 / 0).count() == 100
    left = [n for _, dirs, _ in os.walk(root) for n in dirs if n.startswith(".")]
    assert left == []


def test_a_build_that_fails_publishes_nothing(spark, tmp_path):
    root, source = str(tmp_path / "root"), str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    with pytest.raises(ZeroDivisionError):
        D.derived(spark, root, "t", [source], lambda: 1 / 0)
    assert D.derived(spark, root, "t", [source], lambda: spark.read.parquet(source)).count() == 3


T0 = dt.datetime(2025, 11, 1)


def plain_starts(hours, span, stride):
    out, have = [], set(hours)
    for h in sorted(have):
        if h - 1 not in have:
            end = h
            while end + 1 in have:
                end += 1
            out += range(h, end - span + 2, stride)
    return out


def test_windows_and_their_splits(spark):
    rng = random.Random(3)
    hours = {k: [h for h in range(200) if rng.random() < 0.93] for k in ("a", "b")}
    rows = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h)) for k, hs in hours.items() for h in hs], "k string, hour timestamp_ntz")
    at = lambda r: (r["start"] - T0).total_seconds() / 3600
    starts = S.legal_starts(S.blocks(rows, keys=["k"]), 7, 3).cache()
    want = sorted((k, h) for k, hs in hours.items() for h in plain_starts(hs, 7, 3))
    assert sorted((r["k"], at(r)) for r in starts.collect()) == want and len(want) > 20

    lo, hi = (F.lit(T0 + dt.timedelta(hours=h)).cast("timestamp_ntz") for h in (60, 100))
    for r in S.split_by_date(starts, 7, lo, hi).collect():
        a, z = at(r), at(r) + 6
        assert r["part"] == ("val" if a >= 60 and z <= 100 else None if a <= 100 and z >= 60 else "train")

    split = S.split_with_gap(starts, 7, 0.25).collect()
    order = sorted(h for _, h in want)
    first = order[int(len(order) * 0.75)]
    for r in split:
        assert r["part"] == ("val" if at(r) >= first else "train" if at(r) + 7 <= first else None)
    assert {r["part"] for r in split} == {"train", "val", None} and len(split) == len(want)
    assert {r["part"] for r in S.split_with_gap(starts, 7, 0.0).collect()} == {"train"}
    assert {r["part"] for r in S.split_with_gap(starts.limit(3), 7, 0.5).collect()} == {"train"}
    assert S.split_with_gap(starts.limit(0), 7, 0.5).count() == 0


def test_errors_by_thirds(spark):
    rng = random.Random(8)
    rows = [(lead, rng.uniform(0, 100), rng.uniform(0, 100) if rng.random() < 0.9 else None, rng.uniform(0, 100)) for lead in range(1, 73) for _ in range(5)]
    got = {r["bucket"]: r for r in R.errors_by_thirds(spark.createDataFrame(rows, "lead int, truth double, g double, b double"), "g", "b").collect()}
    known = [r for r in rows if r[2] is not None]
    root = lambda xs: math.sqrt(sum(x * x for x in xs) / len(xs))
    for name, lo, hi in (("0-24h", 1, 24), ("24-48h", 25, 48), ("48-72h", 49, 72)):
        per = [[r for r in known if r[0] == lead] for lead in range(lo, hi + 1)]
        rmse, base = (sum(root([r[c] - r[1] for r in p]) for p in per if p) / sum(map(bool, per)) for c in (2, 3))
        assert got[name]["rmse"] == pytest.approx(rmse) and got[name]["base_rmse"] == pytest.approx(base) and got[name]["skill"] == pytest.approx(1 - rmse / base)
    assert got["all"]["n"] == len(known) and got["all"]["rmse"] == pytest.approx(root([r[2] - r[1] for r in known]))
    assert R.errors_by_thirds(spark.createDataFrame([], "lead int, truth double, g double, b double"), "g", "b").count() == 0
