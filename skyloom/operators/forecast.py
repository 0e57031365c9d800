"""Persistence and bias-corrected forecasts, their samples and fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ["persistence", "diurnal_persistence", "climatology", "raw", "scaled", "scaled_hourly", "blend_persist_diurnal", "blend_diurnal_scaled"]


def local_hour(hour: Column, minutes: int = 330) -> Column:
    return F.hour(hour + F.expr(f"interval {minutes} minutes"))


def corrections(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of the global scale, a ratio of sums over pairs with a positive model value; and by local hour
    the observed mean and scale. Without pairs the global scale is 1; an hour without them has it."""
    ok = F.col("obs").isNotNull() & (F.col("model") > 0)
    ratio = F.sum(F.when(ok, F.col("obs"))) / F.sum(F.when(ok, F.col("model")))
    whole = train.agg(F.coalesce(ratio, F.lit(1.0)).alias("scale"))
    by = train.groupBy(local_hour(F.col("hour")).alias("local_hour")).agg(F.avg("obs").alias("climatology"), ratio.alias("hour_scale"))
    return whole, by


def samples(dense: DataFrame, key: str, whole: DataFrame, by: DataFrame, start: Column, horizon: int = 72, stride: int = 6) -> DataFrame:
    """a row for each station, origin and lead with a known truth, and every method's guess.

    dense: key, hour, obs, model on a dense spine. Origins are every ``stride``-th hour from start on that has a day
    behind and the horizon ahead of it, counted before those without a value go. Leads meet their hours by equality.
    """
    ends = dense.groupBy(key).agg(F.min("hour").alias("__a"), F.max("hour").alias("__b"))
    lo = F.greatest(start, F.col("__a") + F.expr("interval 24 hours"))
    ends = ends.select(key, lo.alias("__lo"), (F.col("__b") - F.expr(f"interval {horizon} hours")).alias("__hi")).where("__lo <= __hi")
    origins = ends.select(key, F.explode(F.sequence("__lo", "__hi", F.expr(f"interval {stride} hours"))).alias("origin"))
    known = dense.where("obs is not null").select(key, F.col("hour").alias("origin"), F.col("obs").alias("persistence"))
    leads = origins.join(known, [key, "origin"]).withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    leads = leads.withColumn("hour", F.col("origin") + F.make_dt_interval(F.lit(0), F.col("lead")))
    truth = dense.where("obs is not null").select(key, "hour", F.col("obs").alias("truth"), F.col("model").alias("raw"))
    day = dense.select(key, (F.col("hour") + F.expr("interval 24 hours")).alias("hour"), F.col("obs").alias("diurnal_persistence"))
    out = leads.join(truth, [key, "hour"]).join(day, [key, "hour"], "left")
    out = out.withColumn("local_hour", local_hour(F.col("hour"))).join(F.broadcast(by), "local_hour", "left").join(F.broadcast(whole))  # 24 rows and one
    out = out.withColumn("scaled", F.col("raw") * F.col("scale")).withColumn("scaled_hourly", F.col("raw") * F.coalesce("hour_scale", "scale"))
    out = out.withColumn("blend_persist_diurnal", F.when(F.col("lead") <= 6, F.col("persistence")).otherwise(F.col("diurnal_persistence")))
    out = out.withColumn("blend_diurnal_scaled", (F.col("diurnal_persistence") + F.col("scaled")) / 2)
    return out.select(key, "origin", "lead", "truth", *METHODS)


def blend(stations: DataFrame, dense: DataFrame, key: str, origin: DataFrame, whole: DataFrame, shares: DataFrame, live: DataFrame | None = None, horizon: int = 72, quorum: float = 0.5) -> DataFrame:
    """value and method of each station and lead after the one origin: the mean of yesterday's same hour and the
    scaled model, either alone where the other is null; the model alone where yesterday's hour lacks a quorum.

    origin: one row (origin). shares: hour, share of stations that reported. live: key, hour, value of another source,
    taken for hours without a quorum of their own if it has one.
    """
    leads = stations.select(key).distinct().join(F.broadcast(origin)).withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    leads = leads.withColumn("hour", F.col("origin") + F.make_dt_interval(F.lit(0), F.col("lead"))).withColumn("back", F.col("hour") - F.expr("interval 24 hours"))
    n = leads.join(dense.select(key, "hour", "model"), [key, "hour"], "left")
    n = n.join(dense.select(key, F.col("hour").alias("back"), "obs"), [key, "back"], "left")
    n = n.join(F.broadcast(shares.select(F.col("hour").alias("back"), "share")), "back", "left")  # an hour each
    ours = F.coalesce(F.col("share") >= quorum, F.lit(False))
    day, method = F.when(ours, F.col("obs")), F.when(ours, "blend").otherwise("model_only")
    if live is not None:
        other = live.groupBy("hour").agg(F.count("value").alias("__n"))
        n = n.join(live.select(key, F.col("hour").alias("back"), F.col("value").alias("__live")), [key, "back"], "left").join(F.broadcast(other.withColumnRenamed("hour", "back")), "back", "left")
        n = n.join(F.broadcast(stations.select(key).distinct().agg(F.count("*").alias("__all"))))
        theirs = ~ours & F.coalesce(F.col("__n") / F.col("__all") >= quorum, F.lit(False))
        day, method = F.when(theirs, F.col("__live")).otherwise(day), F.when(theirs, "blend_live").otherwise(method)
    n = n.join(F.broadcast(whole)).withColumn("__day", day).withColumn("__m", F.col("model") * F.col("scale"))
    value = F.coalesce((F.col("__day") + F.col("__m")) / 2, F.col("__day"), F.col("__m"))
    return n.select(key, "lead", "hour", value.alias("value"), method.alias("method"))


def verdict(pairs: DataFrame, base: str, other: str, truth: str = "truth", thresholds: Sequence[float] = (120.0, 250.0), severe: float = 150.0) -> DataFrame:
    """One row: errors of both, on the severe tail too, and F1 at each threshold against a uniform control that is
    the base scaled to the other's mean."""
    b, o, t = F.col(base), F.col(other), F.col(truth)
    rows = pairs.where(b.isNotNull() & o.isNotNull() & t.isNotNull())
    rows = rows.join(F.broadcast(rows.agg((F.avg(o) / F.avg(b)).alias("factor"))))  # one row
    guesses = {"base": b, "other": o, "uniform": b * F.col("factor")}
    aggs = [F.count("*").alias("n"), F.first("factor").alias("factor"), F.count_if(t >= severe).alias("severe_n")]
    for name, x in guesses.items():
        e = x - t
        aggs += [F.sqrt(F.avg(e * e)).alias(f"{name}_rmse"), F.avg(e).alias(f"{name}_bias"), F.sqrt(F.avg(F.when(t >= severe, e * e))).alias(f"{name}_severe_rmse")]
        for at in thresholds:
            hit, said, real = F.count_if((x >= at) & (t >= at)), F.count_if(x >= at), F.count_if(t >= at)
            aggs.append((2 * hit / F.greatest(said + real, F.lit(1))).alias(f"{name}_f1_{at:g}"))
    return rows.agg(*aggs)
