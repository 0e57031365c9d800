"""Scenario frames: an hourly recursion over optical depth for each district and set of interventions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import index as X
from ..functions.parse import clamp
from ..functions.weather import clear_sky, noise

REGIME, START_HOUR, HOURS = 0.625, 19, 72
# --- fixed values: districts as (position, id, lat, lon, emission, shares of stubble, traffic, industry) ---
DISTRICTS = [
    (0, "delhi", 28.6139, 77.209, 1.12, 0.32, 0.4, 0.28),
    (1, "noida", 28.5355, 77.391, 0.86, 0.24, 0.34, 0.42),
    (2, "gurgaon", 28.4595, 77.0266, 0.78, 0.2, 0.52, 0.28),
    (3, "faridabad", 28.4089, 77.3178, 0.92, 0.18, 0.3, 0.52),
    (4, "ghaziabad", 28.6692, 77.4538, 0.97, 0.38, 0.26, 0.36),
]
DISTRICT_SCHEMA = "di int, district string, lat double, lon double, emission double, stubble double, traffic double, industry double"


def rounded(x: Column, digits: int) -> Column:
    """Halves upwards, as clients round."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def _bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is evaluated once however often then names it: a fold's lambdas share no subexpressions."""
    return F.transform(F.array(x), then)[0]


def _limited(x: Column, low: float, high: float) -> Column:
    return _bound(x, lambda v: clamp(v, low, high))


def _step(aod: Column, h: Column, di: Column, emission: Column, ef: Column, then: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """then(the next optical depth, this hour's values).

    The seeds of noise are summed in whole hundredths and tenths: noise magnifies a sum's last digit by as much as
    10^5, so sums of fractions would show at positions of thousands.
    """
    local, day = F.pmod(h + START_HOUR, F.lit(24)).cast("double"), F.floor((h + START_HOUR) / 24).cast("double")
    whole = di.cast("long")
    jitter = _bound((h * 731 + whole * 377) / F.lit(100.0), noise) - 0.5
    haze = _bound(whole * 51 / F.lit(10.0) + day, noise) * 96
    breeze = 1.5 + F.greatest(F.lit(0.0), F.sin((local - 8) / 24 * math.pi * 2)) * 1.9 + F.sin(h / 19.0 * math.pi) * 0.7 + jitter * 0.6 + day * 0.35

    def mixed(wind: Column, dim: Column, solar: Column) -> Column:
        layer = 236 + haze + F.pow(solar / 720, F.lit(0.85)) * 1750 * (dim * 0.45 + 0.55)
        return _bound(_limited(layer, 60, 1900), lambda pbl: _bound(_limited(pbl / 900 * (wind / 4.5 + 0.42), 0.45, 1.15), lambda air: aired(wind, solar, pbl, air)))

    def aired(wind: Column, solar: Column, pbl: Column, ventilation: Column) -> Column:
        raw = (emission * ef * (REGIME * 41) + (F.sin(h / 17.0) * 7 + 12) * REGIME) / ventilation
        return _bound(_limited(raw, 6, 780), lambda pm: ended(wind, solar, pbl, pm))

    def ended(wind: Column, solar: Column, pbl: Column, pm: Column) -> Column:
        trap = _limited((1 - pbl / 1600) * 0.55 + (1 - wind / 6) * 0.32 + clamp(pm / 200, 0, 1) * 0.18 + F.when(solar < 5, 0.08).otherwise(0.0), 0, 1)
        return then(_limited(aod * 0.62 + pm / 210 * 0.38, 0.05, 2.2), {"pm": pm, "pbl": pbl, "solar": solar, "wind": wind, "trap": trap})

    return _bound(_limited(breeze, 0.3, 7.5), lambda wind: _bound(F.exp(aod * -0.62), lambda dim: _bound(clear_sky(local) * dim, lambda solar: mixed(wind, dim, solar))))


def frames(districts: DataFrame, stubble: float = 0.0, traffic: float = 0.0, industry: float = 0.0) -> DataFrame:
    """district, hour, pm25, aqi, pbl, solar, wind, inversion, alert for hours 0..72 under cuts in percent.

    Each district's hours are one fold over a sequence. Districts are few bytes and much work, so they are dealt to every core.
    """
    ef = F.col("stubble") * (1 - stubble / 100) + F.col("traffic") * (1 - traffic / 100) + F.col("industry") * (1 - industry / 100)
    d = districts.withColumn("ef", ef).repartition(districts.sparkSession.sparkContext.defaultParallelism, "di")
    kind = "array<struct<hour:int,pm:double,pbl:double,solar:double,wind:double,trap:double>>"
    start = F.struct((F.col("ef") * 0.55 + 0.2).alias("aod"), F.array().cast(kind).alias("out"))

    def merge(acc: Column, h: Column) -> Column:
        def added(aod: Column, made: dict[str, Column]) -> Column:
            row = F.struct(h.cast("int").alias("hour"), *[made[k].alias(k) for k in ("pm", "pbl", "solar", "wind", "trap")])
            return F.struct(aod.alias("aod"), F.concat(acc["out"], F.array(row)).alias("out"))

        return _step(acc["aod"], h, F.col("di"), F.col("emission"), F.col("ef"), added)

    out = d.select("district", F.aggregate(F.sequence(F.lit(0), F.lit(HOURS)), start, merge)["out"].alias("o")).select("district", F.inline("o"))
    return out.select(
        "district", "hour", rounded(F.col("pm"), 1).alias("pm25"), X.client_index(F.col("pm")).alias("aqi"), F.floor(F.col("pbl") + 0.5).alias("pbl"), F.floor(F.col("solar") + 0.5).alias("solar"), rounded(F.col("wind"), 1).alias("wind"),
        rounded(F.col("trap"), 2).alias("inversion"), X.alert_level(F.col("pm"), F.col("trap")).alias("alert"),
    )


def with_interventions(live: DataFrame, base: DataFrame, scenario: DataFrame) -> DataFrame:
    """live frames (district, hour, pm25, inversion) times the ratio of two scenarios; unchanged where they lack a frame."""
    r = base.select("district", "hour", F.col("pm25").alias("b")).join(scenario.select("district", "hour", F.col("pm25").alias("s")), ["district", "hour"])
    out = live.join(r, ["district", "hour"], "left").withColumn("x", F.col("pm25") * F.when(F.col("b") > 0, F.col("s") / F.col("b")).otherwise(1.0))
    return out.select("district", "hour", rounded(F.col("x"), 1).alias("pm25"), X.client_index(F.col("x")).alias("aqi"), X.alert_level(F.col("x"), F.col("inversion")).alias("alert"))
