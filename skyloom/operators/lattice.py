"""Coarse fields of a fixed list of districts: what they emit, drifting with their own winds, and those winds blended.

Rows (by, lat, lon, and what a field needs) of one moment meet in one array, so a moment has as many of them as there are
districts, a short list. Each moment's cells are then sums over that array: one exchange, by moment. Rows with a null in what
a field needs don't count; a moment without any other row has no cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the frame of both fields, their cells a side, and the coefficients of drift, spread and blending ---
SOUTH, NORTH, WEST, EAST = 28.28, 28.92, 76.82, 77.62
PLUME_SIDE, WIND_SIDE = 18, 9
DRIFT, DRIFT_SPEED = 0.12, 5.0
SPREAD, SPREAD_OPEN, SPREAD_SPEED = 0.1, 0.055, 0.012
SHARED, NEARBY = 1.9, 0.01


def _celled(rows: DataFrame, by: str, needed: Sequence[str], side: int) -> DataFrame:
    """(by, gy, gx, lat, lon, s): the middle of each cell of a moment beside the array of the moment's districts."""
    held = rows.dropna(subset=[by, *needed]).select(by, F.struct(*needed).alias("s"))
    moments = held.groupBy(by).agg(F.sort_array(F.collect_list("s")).alias("s"))
    cells = moments.select(by, "s", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k"))
    at = cells.select(by, "s", F.floor(F.col("k") / side).cast("int").alias("gy"), (F.col("k") % side).alias("gx"))
    middle = lambda c, low, high: low + (high - low) / side * (F.col(c) + 0.5)
    return at.withColumns({"lat": middle("gy", SOUTH, NORTH), "lon": middle("gx", WEST, EAST)})


def _total(each: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform("s", each), F.lit(0.0), lambda a, x: a + x)


def plume_lattice(districts: DataFrame, by: str, intensity: float = 1.0, side: int = PLUME_SIDE) -> DataFrame:
    """(by, gy, gx, lat, lon, value): Gaussian plumes of pm25, moved downwind and wider in wind and open air.

    districts: by, lat, lon, pm25, wind_dir (degrees it blows from), wind_speed, inversion (0 to 1).
    """
    def share(s: Column) -> Column:
        move = s["wind_speed"] / DRIFT_SPEED * DRIFT
        y = F.col("lat") - (s["lat"] - F.cos(F.radians(s["wind_dir"])) * move)
        x = F.col("lon") - (s["lon"] - F.sin(F.radians(s["wind_dir"])) * move)
        wide = SPREAD + SPREAD_OPEN * (1 - s["inversion"]) + s["wind_speed"] * SPREAD_SPEED
        return s["pm25"] * F.exp(-(y * y + x * x) / (2 * wide * wide))

    needed = ["lat", "lon", "pm25", "wind_dir", "wind_speed", "inversion"]
    cells = _celled(districts, by, needed, side)
    return cells.select(by, "gy", "gx", "lat", "lon", (_total(share) / SHARED * intensity).alias("value"))


def wind_lattice(districts: DataFrame, by: str, side: int = WIND_SIDE) -> DataFrame:
    """(by, gy, gx, lat, lon, dir, speed): the districts' winds, weighted by inverse squared distance in degrees.

    dir is in degrees, -180 to 180, of the mean direction vector; where directions cancel out it is whatever rounding leaves.
    """
    def near(s: Column) -> Column:
        y, x = F.col("lat") - s["lat"], F.col("lon") - s["lon"]
        return 1 / (NEARBY + y * y + x * x)

    needed = ["lat", "lon", "wind_dir", "wind_speed"]
    cells = _celled(districts, by, needed, side)
    sums = cells.select(
        by, "gy", "gx", "lat", "lon",
        _total(near).alias("w"),
        _total(lambda s: near(s) * F.cos(F.radians(s["wind_dir"]))).alias("c"),
        _total(lambda s: near(s) * F.sin(F.radians(s["wind_dir"]))).alias("d"),
        _total(lambda s: near(s) * s["wind_speed"]).alias("v"),
    )
    turn = F.degrees(F.atan2(F.col("d") / F.col("w"), F.col("c") / F.col("w"))).alias("dir")
    return sums.select(by, "gy", "gx", "lat", "lon", turn, (F.col("v") / F.col("w")).alias("speed"))
