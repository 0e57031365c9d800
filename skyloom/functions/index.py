"""Air-quality indices as Column expressions: ladders, their inverses, categories, policy stages and alert levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

Bands = Sequence[tuple[float, float, float, float]]


def ladder(c: Column, bands: Bands, half_open: bool = False) -> Column:
    """Linear interpolation in the first band that holds c; null between bands. Closed bands, or open above with half_open."""
    out = F.lit(None).cast("double")
    for lo, hi, a, b in reversed(bands):
        inside = (c >= float(lo)) & (c < float(hi) if half_open else c <= float(hi))
        out = F.when(inside, (c - float(lo)) * F.lit((b - a) / (hi - lo)) + float(a)).otherwise(out)
    return out


def half_even(x: Column) -> Column:
    """To whole numbers, ties to the even one."""
    return F.rint(x).cast("int")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def by_pollutant(pollutant: Column, make) -> Column:
    """make(key) for the pollutant that the column names; null for others."""
    out = F.lit(None)
    for key in T.SUB_INDEX:
        out = F.when(pollutant == key, make(key)).otherwise(out)
    return out


def sub_index(pollutant: str, c: Column) -> Column:
    """Null for null or negative, 500 above the table."""
    return F.when(c >= 0, F.coalesce(half_even(ladder(c, T.SUB_INDEX[pollutant])), F.lit(500)))


def category(aqi: Column) -> Column:
    """X2"""
    out = F.lit(T.CATEGORIES[-1][1])
    for top, name in reversed(T.CATEGORIES[:-1]):
        out = F.when(aqi <= top, name).otherwise(out)
    return F.when(aqi.isNotNull(), out)


def ingest_category(aqi: Column) -> Column:
    """As X2, with a name for null."""
    return F.coalesce(category(aqi), F.lit("Unknown"))


def policy_index(pm25: Column) -> Column:
    """PM2.5 rounded to a tenth on a gapped ladder, extrapolated above it, 0 for what no band holds."""
    c = F.bround(pm25, 1)
    lo, hi, a, b = T.POLICY_PM25[-1]
    above = (c - lo) * F.lit((b - a) / (hi - lo)) + float(a)
    return F.coalesce(half_even(F.when(c > hi, above).otherwise(ladder(c, T.POLICY_PM25))), F.lit(0))


def ingest_sub_index(pollutant: str, c: Column) -> Column:
    """X4, one pollutant: one decimal, 500 above the table, null in a gap."""
    bands = T.GAPPED[pollutant]
    return F.when(c >= 0, F.when(c > float(bands[-1][1]), 500.0).otherwise(F.bround(ladder(c, bands), 1)))


def ingest_index(pm25: Column, pm10: Column, nox: Column, o3: Column) -> Column:
    """struct(aqi, dominant) of the largest sub-index; ties go to PM2.5, PM10, NOx, O3 in that order."""
    subs = [("PM2.5", ingest_sub_index("pm25", pm25)), ("PM10", ingest_sub_index("pm10", pm10)), ("NOx", ingest_sub_index("nox", nox)), ("O3", ingest_sub_index("o3", o3))]
    top = F.greatest(*[s for _, s in subs])
    who = F.lit(None).cast("string")
    for name, s in reversed(subs):
        who = F.when(s == top, name).otherwise(who)
    return F.struct(top.alias("aqi"), who.alias("dominant"))


def client_index(pm25: Column) -> Column:
    """Half-open bands, the last one for whatever is outside, halves upwards."""
    lo, hi, a, b = T.CLIENT_PM25[-1]
    return F.when(pm25.isNotNull(), half_up(F.coalesce(ladder(pm25, T.CLIENT_PM25, half_open=True), (pm25 - lo) * F.lit((b - a) / (hi - lo)) + float(a))))


def from_foreign(pollutant: str, index: Column) -> Column:
    """A foreign sub-index back to a concentration, half a step above its lower end; the table's top for what no band holds."""
    out = F.lit(float(T.FOREIGN[pollutant][-1][1]))
    for lo, hi, a, b in reversed(T.FOREIGN[pollutant]):
        span = (hi - lo) / (b - a)
        out = F.when(index.between(a, b), F.bround((index - a) * F.lit(span) + float(lo) + span / 2, 2)).otherwise(out)
    return F.when(index.isNotNull(), out)


def pm25_of_index(index: Column) -> Column:
    """The exact inverse of X1 for PM2.5, a quarter step up at the first index of later bands; null between bands."""
    i, out = F.least(index.cast("double"), F.lit(500.0)), F.lit(None).cast("double")
    for lo, hi, a, b in reversed(T.SUB_INDEX["pm25"]):
        step = (hi - lo) / (b - a)
        edge = F.when(i == a, step / 4).otherwise(0.0) if a else F.lit(0.0)
        out = F.when(i.between(a, b), (i - a) * F.lit(step) + float(lo) + edge).otherwise(out)
    return F.when(index >= 0, out)


def pm25_roughly(index: Column) -> Column:
    """The rough inverse; 350 outside the bands."""
    out = F.lit(350.0)
    for lo, hi, a, b in reversed(T.POLICY_PM25):
        out = F.when(index.between(a, b), (index - a) * F.lit((hi - lo) / (b - a)) + float(lo)).otherwise(out)
    return F.when(index.isNotNull(), out)


def policy_stage(aqi: Column) -> Column:
    """struct(stage, category, actions) of an index."""
    out = None
    for top, stage, name, actions in reversed(T.STAGES):
        row = F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("category"), F.array(*map(F.lit, actions)).alias("actions"))
        out = row if out is None else F.when(aqi <= top, row).otherwise(out)
    return F.when(aqi.isNotNull(), out)


def alert_stage(aqi: Column) -> Column:
    """X16"""
    return F.when(aqi > 400, "EMERGENCY").when(aqi > 300, "ALERT").when(aqi > 200, "WATCH").when(aqi.isNotNull(), "NONE")


def alert_level(pm25: Column, inversion: Column) -> Column:
    """Load and trapping as one score."""
    s = pm25 / 120 + inversion * 0.75
    return F.when(s > 1.65, "EMERGENCY").when(s > 1.2, "WARNING").when(s > 0.8, "ADVISORY").when(s.isNotNull(), "NOMINAL")


def station_pm25(own: Column, concentration: Column, index: Column) -> Column:
    """struct(value, basis): the station's value, else its sub-index's concentration, else the inverted sub-index."""
    inverse = pm25_of_index(index)
    measured = F.coalesce(own, concentration)
    return F.struct(F.coalesce(measured, inverse).alias("value"), F.when(measured.isNotNull(), "measured").when(inverse.isNotNull(), "index").otherwise("none").alias("basis"))


def exposure_band(pct: Column) -> Column:
    return F.when(pct < 15, "Minimal").when(pct < 28, "Low").when(pct < 45, "Moderate").when(pct < 65, "Elevated").when(pct < 85, "High").otherwise("Severe")


def exposure_rows(aqi: Column, pm25: Column, co: Column, pm10: Column, no2: Column, so2: Column, o3: Column) -> Column:
    """Array of four struct(id, pct, level, basis) from the composite index and the published sub-indices."""
    whole = F.coalesce(aqi, F.lit(0)).cast("double")
    worst = {"respiratory": (pm25, 1.0), "cardio": (F.greatest(pm25, co), 0.82), "irritant": (F.greatest(pm10, no2, so2), 0.9)}
    rows = []
    for name, (got, weight) in worst.items():
        rows.append((name, F.coalesce(got.cast("double"), whole) * weight, got.isNotNull()))
    rows.append(("exertion", F.greatest(whole, F.coalesce(o3, F.lit(0)) * 1.15) * 1.08, o3.isNotNull()))
    out = []
    for name, x, measured in rows:
        pct = half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x / 400 * 100)))
        out.append(F.struct(F.lit(name).alias("id"), pct.alias("pct"), exposure_band(pct).alias("level"), F.when(measured, "measured").otherwise("composite").alias("basis")))
    return F.array(*out)
