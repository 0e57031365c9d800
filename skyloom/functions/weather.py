"""Weather, dispersion and feedback as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .parse import clamp

# --- fixed values: optical depth per ug/m3, W/m2 per unit, m and degrees per W/m2, limits ---
AOD_PER_PM25, SOLAR_BETA, PBL_ALPHA, TEMP_GAMMA = 0.007, -180.0, -0.42, -0.018
AOD_MOST, PBL_FLOOR, AMPLIFICATION_MOST = 3.5, 50.0, 1.6


def kmh_to_ms(v: Column) -> Column:
    """P9"""
    return v / 3.6


def pbl_archive(h: Column) -> Column:
    """P10: no layer below 50 m."""
    return F.when(h.isNotNull(), F.greatest(F.lit(PBL_FLOOR), h))


def pbl_live(h: Column) -> Column:
    """P10: a layer of 50 m or less is a fill value."""
    return F.when(h > PBL_FLOOR, h)


def normalised(x: Column, channel: str, legacy: bool = False) -> Column:
    """A channel's value in 0..1; the older vector has other scales and no offsets."""
    _, _, offset, scale, old = next(c for c in T.CHANNELS if c[0] == channel)
    return clamp(x / old if legacy else (x + offset) / scale, 0, 1)


def physical(x: Column, channel: str) -> Column:
    """Back from 0..1."""
    _, _, offset, scale, _ = next(c for c in T.CHANNELS if c[0] == channel)
    return x * scale - offset


def humidity(t_kelvin: Column, d_kelvin: Column) -> Column:
    """Relative humidity by the Magnus formula, 0..100."""
    e = lambda k: F.exp((k - 273.15) * 17.67 / (k - 273.15 + 243.5))
    return clamp(e(d_kelvin) / e(t_kelvin) * 100.0, 0, 100)


def decayed(frp: Column, age_h: Column) -> Column:
    """Full for two hours, then linearly to nothing at six; nothing before it was seen."""
    return F.when(age_h < 0, 0.0).when(age_h <= 2, frp).when(age_h <= 6, frp * (1 - (age_h - 2) / 4)).otherwise(0.0)


def dispersion(pbl: Column, wind: Column) -> Column:
    """struct(inversion, ventilation, risk)."""
    known = pbl.isNotNull() & wind.isNotNull()
    risk = F.when((pbl < 300) & (wind < 1.5), "CRITICAL").when((pbl < 500) & (wind < 2.5), "HIGH").when((pbl < 800) | (wind < 3.5), "MODERATE").otherwise("LOW")
    return F.struct(F.coalesce((pbl < 400) & (wind < 2), F.lit(False)).alias("inversion"), F.bround(wind * pbl, 2).alias("ventilation"), F.when(known, risk).otherwise("UNKNOWN").alias("risk"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(x, -60, 60)))


def inversion_index(pm25: Column, pbl: Column, wind: Column) -> Column:
    """X11"""
    s = clamp(pm25 / 500, 0, 1) * 0.45 + clamp(1 - pbl / 2000, 0, 1) * 0.35 + clamp(1 - wind / 10, 0, 1) * 0.20
    return sigmoid((s - 0.5) * 8)


def inversion_severity(isi: Column) -> Column:
    """X13"""
    return F.when(isi > 0.85, "EMERGENCY").when(isi > 0.75, "SEVERE").when(isi.isNotNull(), "MODERATE")


def coupled(pm25: Column, solar: Column, pbl: Column, temp: Column, amplify: bool = False, rounds: int = 3, damping: float = 0.5) -> dict[str, Column]:
    """Aerosol dims the sun, which lowers the layer and the temperature; with amplify that thickens the aerosol, a few rounds."""
    pbl0, pm = pbl_archive(pbl), pm25
    for _ in range(rounds if amplify else 1):
        aod = clamp(F.coalesce(pm, F.lit(0.0)) * AOD_PER_PM25, 0, AOD_MOST)
        d_solar = (sigmoid(aod) - 0.5) * SOLAR_BETA
        d_pbl, d_temp = -d_solar * PBL_ALPHA, -d_solar * TEMP_GAMMA
        if amplify:
            ratio = clamp(pbl0 / F.greatest(pbl0 + d_pbl, F.lit(PBL_FLOOR)), 1, AMPLIFICATION_MOST)
            pm = pm + (pm25 * ratio - pm) * damping
    return {
        "aod": aod,
        "pm25_out": pm,
        "solar_out": F.greatest(solar + d_solar, F.lit(0.0)),
        "pbl_out": F.greatest(pbl0 + d_pbl, F.lit(PBL_FLOOR)),
        "temp_out": temp + d_temp,
        "amplification": F.when(pm25 > 0, pm / pm25).otherwise(1.0),
    }


def field_intensity(field: Column, pm25: Column, o3: Column, nox: Column, pbl: Column, wind: Column) -> Column:
    """0..1 for each field of a map; a deep layer and a strong wind are low."""
    x = F.when(field == "PM10", pm25 * 1.74 / 210).when(field == "O3", o3 / 130).when(field == "NOx", nox / 150).when(field == "PBL", 1 - pbl / 1000).when(field == "WIND", 1 - wind / 6)
    return clamp(x.otherwise(pm25 / 120), 0, 1)


def coverage_status(share: Column) -> Column:
    """Share of hours in percent."""
    return F.when(share >= 90, "ok").when(share >= 60, "degraded").otherwise("offline")


def cycle_start(cycle: Column) -> Column:
    """Ids like 20260916_00z."""
    return F.try_to_timestamp(F.regexp_replace(F.lower(cycle), "z+$", ""), F.lit("yyyyMMdd_HH"))


def freshness(last_valid: Column, started: Column, now: Column, stale_h: float = 24.0, aging_h: float = 6.0) -> Column:
    """What is past its window is expired, whatever its age."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 3.6e9
    return F.when(last_valid <= now, "expired").when(age.isNull(), "unknown").when(age > stale_h, "stale").when(age > aging_h, "aging").otherwise("fresh")


def age_text(minutes: Column) -> Column:
    """Whole minutes (one at least), hours or days."""
    m, h = F.floor(minutes), F.floor(F.floor(minutes) / 60)
    out = F.when(m < 60, F.concat(F.greatest(m, F.lit(1)).cast("string"), F.lit("m"))).when(h < 24, F.concat(h.cast("string"), F.lit("h")))
    return out.otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit("d")))


def clear_sky(hour: Column) -> Column:
    """W/m2 by the hour of the day."""
    x = (hour - 6.2) / 11.6
    return F.when((x <= 0) | (x >= 1), 0.0).otherwise(F.sin(x * math.pi) * 720)


def diurnal(hour: Column) -> Column:
    """A multiplier that peaks before dawn."""
    return F.cos((hour - 7) / 24 * (2 * math.pi)) * 0.32 + 1


def pbl_shape(hour: Column) -> Column:
    """X23"""
    return F.greatest(F.lit(0.0), F.sin((hour - 6) / 12 * math.pi)) * 760 + 240


def noise(seed: Column) -> Column:
    """Repeatable, 0 to 1."""
    x = F.sin(seed * 12.9898) * 43758.5453
    return x - F.floor(x)


def advisory(aqi: Column) -> Column:
    return F.when(aqi <= 50, "Level 1 · Clear").when(aqi <= 100, "Level 2 · Watch").when(aqi <= 200, "Level 3 · Caution").when(aqi <= 300, "Level 4 · Warning").when(aqi <= 400, "Level 5 · Alert").otherwise("Level 6 · Emergency")

