"""Distances, bearings, regions and map coordinates as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    """X20"""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * T.EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column | float, lon1: Column | float, lat2: Column | float, lon2: Column | float) -> Column:
    """The initial bearing, 0 to 360."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2) - _c(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def compass(deg: Column) -> Column:
    """One of 16 points."""
    k = F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.get(F.array(*map(F.lit, T.POINTS)), k)


def planar_km(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    """Flat distance, good over some tens of kilometres."""
    return F.hypot((lat1 - _c(lat2)) * T.KM_LAT, (lon1 - _c(lon2)) * T.KM_LON)


def wind_parts(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """U and v of a wind that blows from a direction; null if either is."""
    r = F.radians(from_deg)
    return -speed * F.sin(r) + 0.0, -speed * F.cos(r) + 0.0


def wind_block(u: Column, v: Column) -> Column:
    """Struct of rounded parts, speed and both directions; null if either part is. A calm keeps the sign of its northward
    part, as IEEE's atan2 has it: -0.0 is south (Spark's atan2 takes it for 0.0)."""
    speed = F.hypot(u, v)
    south = (u == 0) & (v.cast("string") == "-0.0")
    to = F.when(south, 180.0).otherwise(F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0)))
    back = F.pmod(to + 180.0, F.lit(360.0))
    made = F.struct(
        F.bround(speed, 2).alias("speed_ms"), F.bround(speed * 3.6, 1).alias("speed_kmh"), F.bround(to, 1).alias("to_deg"), compass(to).alias("to_compass"), F.bround(back, 1).alias("from_deg"), compass(back).alias("from_compass")
    )
    return F.when(u.isNotNull() & v.isNotNull(), made)


def transit(lat: Column, lon: Column, to_deg: Column, speed_kmh: Column, least_alignment: float = 0.3, horizon_h: float = 72.0) -> Column:
    """struct(carrying, hours, alignment, dist_km) of smoke towards the target; carrying is null without a wind."""
    align = F.cos(F.radians(bearing_deg(lat, lon, *T.TARGET) - to_deg))
    dist = haversine_km(lat, lon, *T.TARGET)
    moves = (align > least_alignment) & (speed_kmh > 0.1)
    hours = F.when(moves, dist / F.when(moves, speed_kmh * align))
    known = to_deg.isNotNull() & speed_kmh.isNotNull()
    return F.struct(
        F.when(known, moves & (hours <= horizon_h)).alias("carrying"),
        F.bround(hours, 1).alias("hours"),
        F.when(known, F.bround(align, 2) + 0.0).alias("alignment"),
        F.when(known, F.bround(dist, 1)).alias("dist_km"),
    )


def zone(lat: Column, lon: Column) -> Column:
    """Centre, or the axis along which the place lies farther off."""
    s, n, w, e = T.CITY_BOX
    dlat, dlon = lat - T.CENTRE[0], lon - T.CENTRE[1]
    out = F.when(~(lat.between(s, n) & lon.between(w, e)), "NCR Outer").when(planar_km(lat, lon, *T.CENTRE) <= T.CENTRAL_KM, "Central")
    return out.when(F.abs(dlat) >= F.abs(dlon), F.when(dlat > 0, "North").otherwise("South")).when(dlon > 0, "East").otherwise("West")


def bulletin_zone(lat: Column, lon: Column) -> Column:
    """P15"""
    south = F.when(lon.between(77.05, 77.35), "South").otherwise("NCR Outer")
    return F.when(lat >= 28.70, "North").when(lat <= 28.50, south).when(lon <= 77.05, "West").when(lon >= 77.30, "East").otherwise("Central")


def latitude_band(lat: Column) -> Column:
    """P16"""
    return F.when(lat >= 30.5, "upper corridor").when(lat >= 29.5, "mid corridor").when(lat >= 28.92, "lower corridor").when(lat >= T.NEAR_BOX[0], "NCR domain").otherwise("south of NCR")


def rough_state(lat: Column, lon: Column) -> Column:
    """Rectangles, tried in order."""
    s, n, w, e = T.NEAR_BOX
    out = F.when(lat.between(s, n) & lon.between(w, e), "Delhi NCR").when(lat >= 31.1, "Punjab / Himachal foothills").when((lat >= 29.6) & (lon <= 76.6), "Punjab")
    return out.when(lat >= 29.6, "Haryana / Chandigarh").when(lon >= 77.3, "Western UP").when((lat < 28.6) & (lon < 76.2), "Northern Rajasthan").otherwise("Haryana")


def ingest_region(lat: Column, lon: Column) -> Column:
    """Other rectangles, tried in order."""
    out = F.lit("Surrounding Buffer")
    for name, s, n, w, e in reversed(T.INGEST_REGIONS):
        out = F.when(lat.between(s, n) & lon.between(w, e), name).otherwise(out)
    return out


def utm(lat: Column, lon: Column, zone_number: int = 43) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS84, by the Krueger series to the third order (within a millimetre)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    p, dl = F.radians(lat), F.radians(lon - float(zone_number * 6 - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(p)) - e * atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east * (k0 * radius) + 500000.0, north * (k0 * radius)


def feature(properties: Sequence[str], names: Mapping[str, str] = {}, lat: str = "lat", lon: str = "lon") -> Column:
    """K6: a row as a GeoJSON feature, a point with the named properties; a null property is left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 4), F.round(lat, 4)).alias("coordinates"))
    own = F.struct(*[F.col(c).alias(names.get(c, c)) for c in properties])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), own.alias("properties")))


def feature_collection(properties: Sequence[str], names: Mapping[str, str] = {}, order: Sequence[str] = (), lat: str = "lat", lon: str = "lon") -> Column:
    """K6: an aggregate: the rows of a group, which one document holds, as a GeoJSON feature collection in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, feature(properties, names, lat, lon).alias("__f"))))
    head, tail = F.lit('{"type":"FeatureCollection","features":['), F.lit("]}")
    return F.concat(head, F.array_join(F.transform(rows, lambda r: r["__f"]), ","), tail)


def grid_index(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The row and column of the first grid line at or above a place, within the grid."""
    g = T.GRID

    def line(x: Column, low: float, high: float, n: int) -> Column:
        k = F.ceil(F.round((x - low) / ((high - low) / (n - 1)), 9))
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), k.cast("int")))

    return line(lat, g["south"], g["north"], g["rows"]), line(lon, g["west"], g["east"], g["cols"])
