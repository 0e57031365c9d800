"""Writing rules of tables with unique keys, as joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row a key, the least by order (which should be unique); from partial aggregates, so hot keys are no hot tasks."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__t"))
    return top.select(*keys, *[F.col(f"__t.__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def last_of(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row a key, the greatest by order."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__t"))
    return top.select(*keys, *[F.col(f"__t.__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def insert_absent(target: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> tuple[DataFrame, DataFrame]:
    """K2: the rows to append, the first of each key that target lacks; and one row (inserted, skipped) of counts."""
    fresh = first_of(new, keys, *order).join(target.select(*keys), list(keys), "left_anti")
    counts = fresh.agg(F.count("*").alias("inserted")).join(F.broadcast(new.agg(F.count("*").alias("__all"))))
    return fresh, counts.select("inserted", (F.col("__all") - F.col("inserted")).alias("skipped"))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """K3, K4: the table after new rows have replaced those of their keys; among new ones the last by order wins."""
    latest = last_of(new, keys, *order)
    return target.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(*target.columns))


def retained(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """K5: rows not older than so many days before the hour of now."""
    return rows.where(F.col(at) >= F.date_trunc("hour", now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def preferred(sources: Sequence[DataFrame], least: int) -> DataFrame:
    """Of several sources in order of preference, the first with at least ``least`` rows, else the last one."""
    ranked = None
    for k, s in enumerate(sources):
        n = s.agg(F.count("*").alias("__n"))
        part = s.join(F.broadcast(n)).withColumn("__rank", F.lit(k)).where((F.col("__n") >= least) | F.lit(k == len(sources) - 1))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.agg(F.min("__rank").alias("__best"))
    return ranked.join(F.broadcast(best)).where("__rank = __best").drop("__n", "__rank", "__best")


def qualified(rows: DataFrame, name: str, agency: str, key: str) -> DataFrame:
    """Names that several rows share get the agency behind them, and the key if that doesn't tell them apart."""
    def with_count(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy(name).agg(F.count("*").alias("__n")), name)

    out = with_count(rows).withColumn(name, F.when((F.col("__n") > 1) & F.col(agency).isNotNull(), F.concat(name, F.lit(" · "), agency)).otherwise(F.col(name))).drop("__n")
    return with_count(out).withColumn(name, F.when(F.col("__n") > 1, F.concat(name, F.lit(" · "), F.col(key).cast("string"))).otherwise(F.col(name))).drop("__n")
