"""Fields that need more than a weighted mean: thin-plate splines, contours, terrain-following wind."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from . import matching as M

# --- fixed values: ridges as (lat, lon, lat, lon, width in degrees), the basin's middle ---
RIDGES = [(28.3, 76.88, 28.66, 77.22, 0.13), (28.82, 77.34, 29.06, 77.78, 0.15)]
BASIN = (28.62, 77.18)
LON_SCALE = math.cos(math.radians(28.6))
#: Cells of a grid that a task adds up in arrays.
MOST_CELLS = 100_000


def thin_plate(p: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at places ``at`` (km) of the thin-plate spline through (p, v); inverse distances below four stations."""
    dist = np.sqrt(((at[:, None] - p[None]) ** 2).sum(2))
    if len(p) < 4:
        w = 1 / np.maximum(dist, 1e-10) ** 2
        return (w * v).sum(1) / w.sum(1) if len(p) else np.full(len(at), np.nan)
    mid, span = p.mean(0), np.abs(p - p.mean(0)).max() or 1.0
    phi = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0)
    q, n = (p - mid) / span, len(p)
    tail = np.column_stack([np.ones(n), q])
    a = np.block([[phi(np.sqrt(((q[:, None] - q[None]) ** 2).sum(2))), tail], [tail.T, np.zeros((3, 3))]])
    c = np.linalg.lstsq(a, np.concatenate([v, np.zeros(3)]), rcond=None)[0]
    return phi(dist / span) @ c[:n] + np.column_stack([np.ones(len(at)), (at - mid) / span]) @ c[n:]


def spline(values: DataFrame, cells: list[tuple[int, int, float, float]], by: str = "hour", most: int = 100) -> DataFrame:
    """(by, gy, gx, value): for each moment of ``by`` a thin-plate spline through its stations (by, lat, lon, value), at the
    cells, a grid of fixed size; an inverse-distance field below four stations.

    Up to ``most`` stations a moment is one solve. More are parted: patches lie over the grid, as many as the stations ask for,
    each solves for the ``most`` stations nearest to its middle, and where patches overlap their fields are blended by weights
    that fall to nothing at a patch's edge. So no solve has more than ``most`` stations, solves grow in number with the
    stations, and the field has no seams. Nulls don't count; of stations at one place any one does.
    """
    places = values.select("lat", "lon").dropna().distinct()
    n = places.count()
    kind = dict(values.dtypes)[by]
    km = lambda la, lo: (la * T.KM_LAT, lo * T.KM_LON)
    at = np.array([km(la, lo) for _, _, la, lo in cells])
    low, size = at.min(0), np.maximum(at.max(0) - at.min(0), 1e-9)
    side = 1 if n <= most else min(math.ceil(math.sqrt(4 * n / most)), math.ceil(math.sqrt(len(cells))))
    middles = [low + size * ((i + 0.5) / side, (j + 0.5) / side) for i in range(side) for j in range(side)]
    #: Half a patch's width both ways; patches overlap by as much again.
    reach = size / side

    def weights(patch: int) -> np.ndarray:
        if side == 1:
            return np.ones(len(at))
        off = np.abs(at - middles[patch]) / reach
        return np.prod(np.maximum(0.0, 1 - off) ** 2, axis=1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["lat", "lon", "value"]).drop_duplicates(["lat", "lon"])
        w = weights(int(pdf["patch"].iloc[0]))
        some = np.flatnonzero(w)
        got = thin_plate(np.column_stack(km(own["lat"], own["lon"])), own["value"].to_numpy(float), at[some])
        return pd.DataFrame({by: pdf[by].iloc[0], "gy": [cells[i][0] for i in some], "gx": [cells[i][1] for i in some], "weight": w[some], "value": got})

    rows = values.select(by, "lat", "lon", "value")
    if side == 1:
        rows = rows.withColumn("patch", F.lit(0))
    else:
        spots = [(i, float(y / T.KM_LAT), float(x / T.KM_LON)) for i, (y, x) in enumerate(middles)]
        patches = values.sparkSession.createDataFrame(spots, "patch int, lat double, lon double")  # not more than cells
        near = M.neighbours(patches, places.withColumn("id", F.struct("lat", "lon")), most, ["patch"])
        rows = rows.join(near.select("patch", "id.lat", "id.lon"), ["lat", "lon"])
    parts = rows.groupBy(by, "patch").applyInPandas(solve, f"{by} {kind}, gy int, gx int, weight double, value double")
    known = parts.where(F.col("value").isNotNull() & ~F.isnan("value"))
    mean = F.sum(F.col("weight") * F.col("value")) / F.sum("weight")
    return known.groupBy(by, "gy", "gx").agg(mean.alias("value"))


def contours(field: DataFrame, threshold: float) -> DataFrame:
    """Line segments (y, x, segment, x1, y1, x2, y2) where a field (gy, gx, value) crosses the threshold.

    Corners meet by equality on neighbouring cells. In a saddle the cell's mean decides how the strands pass; segments
    of no length are left out.
    """
    corner = lambda name, dy, dx: field.select((F.col("gy") - dy).alias("y"), (F.col("gx") - dx).alias("x"), F.col("value").alias(name))
    c = corner("tl", 0, 0).join(corner("tr", 0, 1), ["y", "x"]).join(corner("br", 1, 1), ["y", "x"]).join(corner("bl", 1, 0), ["y", "x"])
    bit = lambda k, w: F.when(F.col(k) >= threshold, w).otherwise(0)
    c = c.withColumn("k", bit("tl", 8) + bit("tr", 4) + bit("br", 2) + bit("bl", 1))
    between = lambda a, b: (F.lit(threshold) - F.col(a)) / F.when(F.col(a) != F.col(b), F.col(b) - F.col(a))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    edge = {"t": (x + between("tl", "tr"), y), "r": (x + 1, y + between("tr", "br")), "b": (x + between("bl", "br"), y + 1), "l": (x, y + between("tl", "bl"))}
    cases = {1: "lb", 2: "br", 3: "lr", 4: "tr", 6: "tb", 7: "lt", 8: "lt", 9: "tb", 11: "tr", 12: "lr", 13: "br", 14: "lb"}

    def lines(*pairs: str) -> Column:
        return F.array(*[F.struct(edge[a][0].alias("x1"), edge[a][1].alias("y1"), edge[b][0].alias("x2"), edge[b][1].alias("y2")) for a, b in pairs])

    joined = (F.col("tl") + F.col("tr") + F.col("br") + F.col("bl")) / 4 >= threshold
    found = F.when((F.col("k") == 5) == joined, lines("lt", "br")).otherwise(lines("lb", "tr"))
    found = F.when(F.col("k").isin(5, 10), found)
    for k, pair in cases.items():
        found = found.when(F.col("k") == k, lines(pair))
    out = c.where(~F.col("k").isin(0, 15)).select("y", "x", F.posexplode(found).alias("segment", "s")).select("y", "x", "segment", "s.*")
    return out.where((F.abs(F.col("x1") - F.col("x2")) > 1e-9) | (F.abs(F.col("y1") - F.col("y2")) > 1e-9))


def polylines(segments: DataFrame, by: Sequence[str], passes: int = 2) -> DataFrame:
    """Segments (*by, x1, y1, x2, y2) joined end to end into lines (*by, line, closed, points), with cut corners.

    Open lines are walked from their ends, then rings from any point. Lines of fewer than three different points are
    left out. A group is one field at one level, which its grid bounds, and is walked in one task. Each of ``passes``
    puts two points on every stretch, at a quarter and three quarters of it; open lines keep their ends.
    """
    kinds = dict(segments.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "line int, closed boolean, points array<struct<x: double, y: double>>"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.round(pdf[["x1", "y1", "x2", "y2"]].sort_values(["y1", "x1", "y2", "x2"]).to_numpy(float), 9)
        touching: dict[tuple, list[int]] = {}
        for i, (x1, y1, x2, y2) in enumerate(ends):
            touching.setdefault((x1, y1), []).append(i)
            touching.setdefault((x2, y2), []).append(i)
        free, found = set(range(len(ends))), []
        for start in [p for p, t in touching.items() if len(t) % 2] + list(touching):
            while any(i in free for i in touching[start]):
                path = [start]
                while (i := next((i for i in touching[path[-1]] if i in free), None)) is not None:
                    free.remove(i)
                    a, b = tuple(ends[i, :2]), tuple(ends[i, 2:])
                    path.append(b if a == path[-1] else a)
                    if path[-1] == start:
                        break
                if len(set(path)) >= 3:
                    found.append(path)
        rows = [(path[0] == path[-1], [{"x": x, "y": y} for x, y in _cut(np.array(path), passes)]) for path in found]
        head = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**head, "line": n, "closed": closed, "points": points} for n, (closed, points) in enumerate(rows)], columns=[*by, "line", "closed", "points"])

    return segments.groupBy(*by).applyInPandas(walk, schema)


def _cut(points: np.ndarray, passes: int) -> np.ndarray:
    """Corner cutting; of a ring the first point comes again at its end."""
    closed = bool((points[0] == points[-1]).all())
    for _ in range(passes):
        a, b = points[:-1], points[1:]
        cut = np.stack([a * 0.75 + b * 0.25, a * 0.25 + b * 0.75], 1).reshape(-1, 2)
        points = np.vstack([cut, cut[:1]]) if closed else np.vstack([points[:1], cut, points[-1:]])
    return points


def flow(cells: DataFrame, winds: DataFrame, keys: Sequence[str] = ("gy", "gx"), by: Sequence[str] = ()) -> DataFrame:
    """Cells (*keys, lat, lon), a grid of fixed size, with the direction of flow (u, v) there: the mean of unit vectors
    of all winds (lat, lon, from_deg), weighted by the inverse square of their distance; from the north-west without any.

    With ``by``, a field for each of its values among the winds. Each task adds its winds up in arrays of all cells, a
    row for each field that a batch touches, so no wind is sent to every cell; the arrays are then added cell by cell.
    """
    at = cells.select("lat", "lon", *keys).orderBy(*keys).toPandas()
    if len(at) > MOST_CELLS:
        raise ValueError(f"a grid of {len(at)} cells is more than the {MOST_CELLS} that a task adds up in arrays")
    lat, lon = at["lat"].to_numpy(float), at["lon"].to_numpy(float)
    kinds = dict(winds.dtypes)
    head = [f"{c} {kinds[c]}" for c in by]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(list(by), sort=False) if by else [((), batch)]
            for key, own in groups:
                su, sv = np.zeros(len(at)), np.zeros(len(at))
                for i in range(0, len(own), 256):
                    w = own.iloc[i : i + 256]
                    dy = lat - w["lat"].to_numpy()[:, None]
                    dx = (lon - w["lon"].to_numpy()[:, None]) * LON_SCALE
                    near = 1 / np.maximum(dy * dy + dx * dx, 1e-4)
                    toward = np.radians(w["from_deg"].to_numpy() + 180.0)
                    su, sv = su + np.sin(toward) @ near, sv + np.cos(toward) @ near
                yield pd.DataFrame([[*key, su, sv]], columns=[*by, "__su", "__sv"])

    w = winds.dropna(subset=[*by, "lat", "lon", "from_deg"]).select(*by, *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "from_deg")])
    sums = w.mapInPandas(add, ", ".join([*head, "__su array<double>, __sv array<double>"]))
    each = sums.select(*by, F.posexplode(F.arrays_zip("__su", "__sv")).alias("__k", "__s"))
    summed = each.groupBy(*by, "__k").agg(F.sum("__s.__su").alias("__su"), F.sum("__s.__sv").alias("__sv"))
    placed = F.broadcast(cells.sparkSession.createDataFrame(at.assign(__k=range(len(at))), _schema_of(cells, keys)))  # MOST_CELLS at most
    size = F.hypot("__su", "__sv")
    part = lambda c, still: F.when(size > 0, F.col(c) / size).otherwise(F.when(size == 0, 0.0).otherwise(still))
    out = summed.join(placed, "__k") if by else placed.join(F.broadcast(summed), "__k", "left")  # a row for each cell at most
    return out.withColumn("u", part("__su", 0.7071)).withColumn("v", part("__sv", -0.7071)).drop("__su", "__sv", "__k")


def _schema_of(cells: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(cells.dtypes)
    return ", ".join(["lat double, lon double", *[f"{c} {kinds[c]}" for c in keys], "__k int"])


def terrain_wind(lat: Column, lon: Column, u: Column, v: Column, stagnation: Column | float, mean_speed: Column | float) -> tuple[Column, Column, Column]:
    """A flow direction turned along ridges it nears and drawn into the basin, with its slowed-down speed."""
    blocked = F.lit(0.0)
    for alat, alon, blat, blon, width in RIDGES:
        ax, ay, dx, dy = alon * LON_SCALE, alat, (blon - alon) * LON_SCALE, blat - alat
        size = math.hypot(dx, dy)
        tx, ty = dx / size, dy / size
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon * LON_SCALE - ax) * tx + (lat - ay) * ty) / size))
        off = F.hypot(lon * LON_SCALE - (along * dx + ax), lat - (along * dy + ay))
        w = F.exp(-F.pow(off / width, 2))
        w = F.when(w >= 0.01, w).otherwise(0.0)
        blocked = F.greatest(blocked, w)
        way = F.when(u * tx + v * ty >= 0, 1.15).otherwise(-1.15)
        u, v = u + way * w * tx, v + way * w * ty
    dlat, dlon = BASIN[0] - lat, (BASIN[1] - lon) * LON_SCALE
    dist = F.greatest(F.hypot(dlat, dlon), F.lit(1e-6))
    pull = F.exp(-F.pow(dist / 0.34, 2)) * (stagnation * 1.25)
    u, v = u + dlon / dist * pull, v + dlat / dist * pull
    size = F.greatest(F.hypot(u, v), F.lit(1e-300))
    speed = (1 - blocked * 0.4) * (1 - F.exp(-F.pow(dist / 0.3, 2)) * (stagnation * 0.45)) * (mean_speed * (0.4 + 0.85 * (1 - stagnation)))
    return u / size * speed, v / size * speed, speed
