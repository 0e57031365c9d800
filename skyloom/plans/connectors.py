"""Queries through the paged source and derived tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import derived as D
from ..sources.bridge import LARGE, SMALL, observations, sql, steady, steady_sql
from ..sources.pages import Pages
from ..sources.scratch import scratch
from .registry import Registry
from .series import hp

REG = Registry()
query = REG.query
RECORD = "event_id long, station_id long, pollutant_id string, avg_value string, last_update string"
#: Records of a page, as the bulletin has them.
PAGE = 500


def publish(rows: DataFrame, path: str) -> None:
    """Records as pages of JSON documents of at most PAGE records each, a document a line, several to a file."""
    numbered = rows.withColumn("page", F.floor(F.col("event_id") / PAGE))
    record = F.struct(*[c for c in rows.columns])
    pages = numbered.groupBy("page").agg(F.sort_array(F.collect_list(record)).alias("records"))  # PAGE records at most
    pages.select(F.to_json(F.struct("page", F.size("records").alias("count"), "records"))).write.mode("append").text(path)


def bulletin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a bulletin gives them: numbers and moments are texts, every seventh number is missing."""
    number = F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.col("value").cast("string"))
    at = F.date_format("ts", "dd-MM-yyyy HH:mm:ss")
    return observations(spark, sf_dir, SMALL).select("event_id", "station_id", F.upper("parameter").alias("pollutant_id"), number.alias("avg_value"), at.alias("last_update"))


def read(rows: DataFrame) -> DataFrame:
    """A bulletin's records as numbers and moments."""
    at = F.to_timestamp_ntz("last_update", F.lit("dd-MM-yyyy HH:mm:ss"))
    return rows.select("event_id", "station_id", F.lower("pollutant_id").alias("parameter"), F.col("avg_value").try_cast("double").alias("value"), at.alias("ts"))


@query(
    "s7_paged_source",
    sql("SELECT parameter, count(*) AS n, count(*) FILTER (event_id % 7 <> 0) AS measured, max(value) FILTER (event_id % 7 <> 0) AS top, date_trunc('second', max(ts)) AS newest FROM obs GROUP BY parameter", "obs"),
)
def s7(spark, sf_dir):
    """A bulletin in pages, read side by side: a partition a page."""
    path = scratch(spark, "bulletin")
    publish(bulletin(spark, sf_dir), path)
    spark.dataSource.register(Pages)
    rows = read(spark.read.format("pages").schema(RECORD).load(path))
    return rows.groupBy("parameter").agg(F.count("*").alias("n"), F.count("value").alias("measured"), F.max("value").alias("top"), F.max("ts").alias("newest"))


@query(
    "s8_paged_stream",
    sql("SELECT station_id, count(*) AS n, max(event_id) AS last FROM obs GROUP BY station_id", "obs"),
)
def s8(spark, sf_dir):
    """The same pages as a stream, which is stopped after the first half has come and goes on from its offset with the second."""
    path, table, at = (scratch(spark, x) for x in ("bulletin", "read", "at"))
    spark.dataSource.register(Pages)
    rows = bulletin(spark, sf_dir)
    for half in (0, 1):
        # The names of a later write would stand anywhere among the earlier ones: each half has a folder, and pages are named behind.
        part = scratch(spark, "half")
        publish(rows.where(F.floor(F.col("event_id") / PAGE) % 2 == half), part)
        _move_behind(spark, part, path, half)
        stream = spark.readStream.format("pages").schema(RECORD).load(path)
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RECORD).parquet(table).groupBy("station_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def _move_behind(spark: SparkSession, source: str, target: str, number: int) -> None:
    """Renames the files of a write into a folder of pages, with names that stand behind those of earlier numbers."""
    path, files = D._path(spark, source)
    there, _ = D._path(spark, target)
    files.mkdirs(there)
    for f in files.listStatus(path):
        name = f.getPath().getName()
        if name[0] not in "._":
            files.rename(f.getPath(), D._path(spark, f"{target}/{number:06d}-{name}")[0])


@query(
    "k7_derived_table",
    sql(f"SELECT station_id, parameter, count(*) AS hours, {steady_sql('avg(value)')} AS mean FROM hp GROUP BY ALL", "hp"),
)
def k7(spark, sf_dir):
    """The hourly table is built at the first question and read at the second, for its files are the same."""
    root, inputs = scratch(spark, "derived"), [f"{sf_dir}/events.parquet"]

    D.derived(spark, root, "hourly", inputs, lambda: hp(spark, sf_dir, SMALL), {"sensors": SMALL})

    def never() -> DataFrame:
        raise RuntimeError("the table is there")

    table = D.derived(spark, root, "hourly", inputs, never, {"sensors": SMALL})
    return table.groupBy("station_id", "parameter").agg(F.count("*").alias("hours"), steady(F.avg("value")).alias("mean"))


@query(
    "r7_stale_while_rebuilt",
    sql("SELECT station_id, max(hour) AS newest, count(*) AS hours FROM hp_large GROUP BY station_id", "hp_large"),
)
def r7(spark, sf_dir):
    """Of changed input the older table is served while the new one is built; then the new one is."""
    root, source = scratch(spark, "derived"), scratch(spark, "input")
    rows = hp(spark, sf_dir, LARGE)
    middle = rows.agg(F.expr("timestampadd(SECOND, cast(timestampdiff(SECOND, min(hour), max(hour)) / 2 AS INT), min(hour))").alias("middle"))
    marked = rows.join(F.broadcast(middle))  # one row
    build = lambda: spark.read.schema(rows.schema).parquet(source)
    served = []
    for half in (F.col("hour") < F.col("middle"), F.col("hour") >= F.col("middle")):
        marked.where(half).drop("middle").write.mode("append").parquet(source)
        served.append(D.derived(spark, root, "hours", [source], build, stale=True))
    D.settle()
    newest = D.derived(spark, root, "hours", [source], build, stale=True)
    older = served[1].select("station_id", "parameter", "hour")  # what was known when the second half had just come
    both = older.unionByName(newest.select("station_id", "parameter", "hour")).distinct()
    return both.groupBy("station_id").agg(F.max("hour").alias("newest"), F.count("*").alias("hours"))
