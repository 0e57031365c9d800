"""Roll-ups of indexed networks: station index, city days, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import index as X
from ..functions import tables as T
from .timeseries import densify, index_window


def station_index(windowed: DataFrame, keys: Sequence[str], parameter: str = "parameter", value: str = "windowed") -> DataFrame:
    """A2: index, prominent pollutant and validity of each key from one window value a pollutant.

    The index is the worst sub-index; ties go to the pollutant that comes first in the table. Fewer than three
    pollutants, or neither PM2.5 nor PM10, make it invalid, with the reasons in place of a number.
    """
    order = list(T.SUB_INDEX)
    sub = windowed.withColumn("__sub", X.by_pollutant(F.col(parameter), lambda p: X.sub_index(p, F.col(value))))
    rank = F.lit(-1) * F.array_position(F.array(*map(F.lit, order)), F.col(parameter))
    has = F.col("__sub").isNotNull()
    out = sub.groupBy(*keys).agg(
        F.max(F.when(has, F.struct("__sub", rank.alias("r"), F.col(parameter).alias("p")))).alias("top"),
        F.count("__sub").cast("int").alias("n_pollutants"),
        F.coalesce(F.bool_or(F.when(has, F.col(parameter).isin("pm25", "pm10"))), F.lit(False)).alias("particulate"),
    )
    ok = (F.col("n_pollutants") >= 3) & F.col("particulate")
    few = F.when(F.col("n_pollutants") < 3, F.format_string("%d usable pollutant(s), 3 required", "n_pollutants"))
    none = F.when(~F.col("particulate"), F.lit("neither PM2.5 nor PM10"))
    aqi = F.when(ok, F.col("top.__sub"))
    return out.select(*keys, ok.alias("valid"), aqi.alias("aqi"), X.category(aqi).alias("category"), F.when(ok, F.col("top.p")).alias("prominent"), "n_pollutants", F.concat_ws("; ", few, none).alias("reasons"))


def hourly_index(hourly: DataFrame, station: str = "station_id", parameter: str = "parameter") -> DataFrame:
    """The index of each station at each hour, from hourly means by station and pollutant."""
    dense = densify(hourly, [station, parameter])
    eight = F.col(parameter).isin(*[p for p, h in T.AVERAGING_HOURS.items() if h == 8])
    return station_index(index_window(dense, [station, parameter], eight), [station, "hour"], parameter)


def city_days(hourly: DataFrame, least_pct: float = 20.0, offset: str = "interval 330 minutes", station: str = "station_id") -> DataFrame:
    """A3: the mean over stations of each station's mean of a local day, with the share of station-hours reported.

    Days below least_pct are left out. The whole is all stations at all hours that anyone reported.
    """
    day = (F.col("hour") + F.expr(offset)).cast("date")
    rows = hourly.where(F.col("value").isNotNull()).withColumn("day", day)
    per = rows.groupBy("day", station).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    # The hours of a day that anyone reported: distinct first, so that the count is one of hours, not of rows.
    hours = rows.select("day", "hour").distinct().groupBy("day").agg(F.count("*").alias("hours"))
    total = rows.select(station).distinct().agg(F.count("*").alias("all"))
    days = per.groupBy("day").agg(F.avg("m").alias("pm25"), F.sum("n").alias("n"), F.count("*").cast("int").alias("stations")).join(hours, "day").join(F.broadcast(total))
    days = days.withColumn("coverage_pct", F.bround(F.col("n") / (F.col("hours") * F.col("all")) * 100, 1)).where(F.col("coverage_pct") >= least_pct)
    aqi = X.sub_index("pm25", F.col("pm25"))
    return days.select("day", F.round("pm25", 6).alias("pm25"), aqi.alias("aqi"), X.category(aqi).alias("band"), "stations", "coverage_pct")


def errors(samples: DataFrame, methods: Sequence[str], truth: str = "truth", by: Sequence[str | Column] = ()) -> DataFrame:
    """N, rmse, mae and bias of each method over the pairs where both are known."""
    long = samples.select(*by, truth, F.explode(F.map_from_arrays(F.array(*map(F.lit, methods)), F.array(*methods))).alias("method", "guess")).where(F.col(truth).isNotNull() & F.col("guess").isNotNull())
    names = [b if isinstance(b, str) else b._jc.toString() for b in by]
    e = F.col("guess") - F.col(truth)
    return long.groupBy(*names, "method").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def errors_by_thirds(samples: DataFrame, guess: str, base: str, truth: str = "truth", lead: str = "lead", third: int = 24) -> DataFrame:
    """(bucket, n, rmse, base_rmse, skill): for each third of the horizon the mean over its leads of the root mean squared
    error at that lead; ``all`` for all pairs together. skill is 1 - rmse / base_rmse, 0 where the base makes no error.

    Leads count from 1; the last third takes all that is left. Pairs count where truth and both guesses are known.
    """
    rows = samples.dropna(subset=[truth, guess, base, lead])
    square = lambda c: F.pow(F.col(c) - F.col(truth), F.lit(2))
    sums = [F.count("*").alias("n"), F.sum(square(guess)).alias("s"), F.sum(square(base)).alias("b")]
    each = rows.groupBy(F.col(lead).alias("lead")).agg(*sums)  # a row a lead
    name = lambda k: f"{k * third}-{(k + 1) * third}h"
    bucket = F.when(F.col("lead") <= third, name(0)).when(F.col("lead") <= 2 * third, name(1)).otherwise(name(2))
    root = lambda c: F.avg(F.sqrt(F.col(c) / F.col("n"))).alias("rmse" if c == "s" else "base_rmse")
    whole = lambda c: F.sqrt(F.sum(c) / F.sum("n")).alias("rmse" if c == "s" else "base_rmse")
    parts = each.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), root("s"), root("b"))
    every = each.groupBy(F.lit("all").alias("bucket")).agg(F.sum("n").alias("n"), whole("s"), whole("b"))
    skill = F.when(F.col("base_rmse") > 0, 1 - F.col("rmse") / F.col("base_rmse")).otherwise(0.0)
    return parts.unionByName(every).withColumn("skill", skill)


def mode(value: Column) -> Column:
    """The most frequent value; of several the least."""
    return F.mode(value, True)


def circular_mean(degrees: Column) -> Column:
    """Null where the directions cancel out."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.when(F.hypot(s, c) >= 1e-6, F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0)))


def upper_median(value: str) -> Column:
    """Of an even number of values of a column the higher middle one, from counts of different values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def newest(rows: DataFrame, keys: Sequence[str], at: str, ties: bool = True) -> DataFrame:
    """The rows of each key's latest moment, all of them if several share it; by a partial aggregate and a join."""
    top = rows.groupBy(*keys).agg(F.max(at).alias(at))
    return rows.join(top, [*keys, at], "left_semi") if ties else rows.join(top, [*keys, at]).dropDuplicates([*keys])

