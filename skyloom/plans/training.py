"""Queries of training windows, their splits and scores by lead, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup as R
from ..operators import timeseries as S
from ..sources.bridge import sql, steady, steady_sql
from .registry import Registry
from .relations import F2_SQL, backtest
from .series import h_small

REG = Registry()
query = REG.query
#: Hours of a window (what it looks at and what it foretells), hours between windows, the part held out.
SPAN, STRIDE, FRACTION = 8, 2, 0.2
_STARTS = f"""k AS (SELECT station_id, hour, epoch(hour) // 3600 - row_number() OVER (PARTITION BY station_id ORDER BY hour) AS k FROM h_small),
    b AS (SELECT station_id, min(hour) AS a, max(hour) AS z FROM k GROUP BY station_id, k HAVING count(*) >= {SPAN}),
    s AS MATERIALIZED (SELECT station_id, unnest(generate_series(a, z - INTERVAL {SPAN - 1} HOUR, INTERVAL {STRIDE} HOUR)) AS start FROM b)"""
_PARTS = "station_id, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part IS NULL) AS between"


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = S.blocks(h_small(spark, sf_dir).select("station_id", "hour"), keys=["station_id"])
    return S.legal_starts(runs, SPAN, STRIDE)


def _parts(rows: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    part = F.col("part")
    return rows.groupBy("station_id").agg(count(part == "train", "train"), count(part == "val", "val"), count(part.isNull(), "between"))


@query(
    "w18_split_with_gap",
    sql(
        f""", {_STARTS}, o AS (SELECT start, row_number() OVER (ORDER BY start) AS i, count(*) OVER () AS n FROM s),
        f AS (SELECT min(start) AS first FROM o WHERE i > floor(n * (1 - {FRACTION}::DOUBLE))),
        p AS (SELECT s.*, CASE WHEN start >= first THEN 'val' WHEN start + INTERVAL {SPAN} HOUR <= first THEN 'train' END AS part FROM s, f)
        SELECT {_PARTS.replace("between", '"between"')} FROM p GROUP BY station_id""",
        "h_small",
    ),
)
def w18_gap(spark, sf_dir):
    """The latest fifth of all stations' windows is held out; none that overlaps its beginning trains."""
    return _parts(S.split_with_gap(starts(spark, sf_dir), SPAN, FRACTION))


@query(
    "w18_split_by_date",
    sql(
        f""", {_STARTS}, e AS (SELECT *, start + INTERVAL {SPAN - 1} HOUR AS z, TIMESTAMP '2024-01-10' AS lo, TIMESTAMP '2024-01-15 23:00:00' AS hi FROM s),
        p AS (SELECT *, CASE WHEN start >= lo AND z <= hi THEN 'val' WHEN NOT (start <= hi AND z >= lo) THEN 'train' END AS part FROM e)
        SELECT {_PARTS.replace("between", '"between"')} FROM p GROUP BY station_id""",
        "h_small",
    ),
)
def w18_dates(spark, sf_dir):
    """Six stated days are held out; no window that touches them trains."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return _parts(S.split_by_date(starts(spark, sf_dir), SPAN, at("2024-01-10"), at("2024-01-15 23:00:00")))


_SQUARES = "pow(blend_diurnal_scaled - truth, 2) AS s, pow(persistence - truth, 2) AS b"
_SKILL = "CASE WHEN b > 0 THEN 1 - r / b ELSE 0 END"


@query(
    "w19_errors_by_thirds",
    sql(
        f""", {F2_SQL}, q AS (SELECT lead, {_SQUARES} FROM s WHERE blend_diurnal_scaled IS NOT NULL AND persistence IS NOT NULL AND truth IS NOT NULL),
        each AS (SELECT lead, count(*) AS n, sqrt(avg(s)) AS r, sqrt(avg(b)) AS b FROM q GROUP BY lead),
        t AS (SELECT CASE WHEN lead <= 24 THEN '0-24h' WHEN lead <= 48 THEN '24-48h' ELSE '48-72h' END AS bucket, sum(n)::BIGINT AS n, avg(r) AS r, avg(b) AS b FROM each GROUP BY 1
          UNION ALL SELECT 'all', count(*), sqrt(avg(s)), sqrt(avg(b)) FROM q HAVING count(*) > 0)
        SELECT bucket, n, {steady_sql("r")} AS rmse, {steady_sql("b")} AS base_rmse, {steady_sql(_SKILL)} AS skill FROM t""",
        "h_small",
    ),
)
def w19(spark, sf_dir):
    out = R.errors_by_thirds(backtest(spark, sf_dir), "blend_diurnal_scaled", "persistence")
    return out.select("bucket", "n", *[steady(F.col(c)).alias(c) for c in ("rmse", "base_rmse", "skill")])
