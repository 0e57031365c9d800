"""Evenly spaced lines along a wind field, one field a group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Field:
    """A field on a regular lattice with bilinear values between; x and y run from 0 to 1, west to east and south to north."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.rows, self.cols = u.shape
        self.u, self.v = u.tolist(), v.tolist()

    def direction(self, x: float, y: float) -> tuple[float, float] | None:
        """The unit vector of the flow; None beyond the lattice, in a calm and beside cells that nothing is known of."""
        if not (0 <= x <= 1 and 0 <= y <= 1):
            return None
        fx, fy = x * (self.cols - 1), y * (self.rows - 1)
        i, j = min(int(fy), self.rows - 2), min(int(fx), self.cols - 2)
        fy, fx = fy - i, fx - j
        corner = ((1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx)
        at = ((i, j), (i, j + 1), (i + 1, j), (i + 1, j + 1))
        u = sum(w * self.u[a][b] for w, (a, b) in zip(corner, at, strict=True) if w)
        v = sum(w * self.v[a][b] for w, (a, b) in zip(corner, at, strict=True) if w)
        size = math.hypot(u, v)
        return (u / size, v / size) if size >= 1e-6 else None  # a NaN compares as false


def trace(field: Field, x: float, y: float, step: float, sign: int) -> tuple[float, float] | None:
    """One midpoint step of unit speed along the flow or (sign -1) against it; None where there is no flow or the edge is crossed."""
    first = field.direction(x, y)
    half = first and field.direction(x + sign * step / 2 * first[0], y + sign * step / 2 * first[1])
    if not half:
        return None
    x, y = x + sign * step * half[0], y + sign * step * half[1]
    return (x, y) if 0 <= x <= 1 and 0 <= y <= 1 else None


def lines_of(field: Field, seeds: int, step: float, most: int, spacing: int, least: int) -> list[list[tuple[float, float]]]:
    """Lines from seeds dealt over the square in a scattered order. A line ends where it enters a cell of the occupancy grid
    that an earlier line has passed, or after ``most`` steps either way; lines of fewer than ``least`` points are let go."""
    taken = np.zeros((spacing, spacing), bool)
    cell = lambda p: (min(int(p[1] * spacing), spacing - 1), min(int(p[0] * spacing), spacing - 1))
    golden = (math.sqrt(5) - 1) / 2
    found = []
    for n in sorted(range(seeds * seeds), key=lambda n: n * golden % 1):
        start = ((n % seeds + 0.5) / seeds, (n // seeds + 0.5) / seeds)
        home = cell(start)
        if taken[home]:
            continue
        halves = []
        for sign in (-1, 1):
            half, p = [], start
            while len(half) < most and (p := trace(field, *p, step, sign)) and not taken[cell(p)]:
                half.append(p)
            halves.append(half)
        line = [*halves[0][::-1], start, *halves[1]]
        if len(line) >= least:
            for p in line:
                taken[cell(p)] = True
            found.append(line)
    return found


def streamlines(
    winds: DataFrame,
    rows: int,
    cols: int,
    by: Sequence[str] = ("hour",),
    bounds: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0),
    seeds: int = 26,
    step: float = 0.015,
    most: int = 90,
    spacing: int = 46,
    least: int = 10,
) -> DataFrame:
    """(*by, line, points) of fields (*by, gy, gx, u, v) on a lattice of rows x cols; points are (lat, lon) along the flow.

    ``bounds`` are south, north, west and east. u and v are taken in the lattice's own proportions. A group is one field,
    which its lattice bounds, and is walked in one task; fields spread over all tasks. Lattice points without a row, and
    null ones, have no flow; of repeated ones the last counts; a field without flow has no line.
    """
    kinds = dict(winds.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "line int, points array<struct<lat: double, lon: double>>"])
    south, north, west, east = bounds

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = np.full((rows, cols), np.nan), np.full((rows, cols), np.nan)
        pdf = pdf[pdf["gy"].between(0, rows - 1) & pdf["gx"].between(0, cols - 1)]
        at = pdf["gy"].to_numpy(int), pdf["gx"].to_numpy(int)
        u[at], v[at] = pdf["u"].to_numpy(float), pdf["v"].to_numpy(float)
        place = lambda p: {"lat": south + p[1] * (north - south), "lon": west + p[0] * (east - west)}
        found = lines_of(Field(u, v), seeds, step, most, spacing, least)
        head = {c: pdf[c].iloc[0] for c in by} if len(pdf) else {}
        made = [{**head, "line": n, "points": list(map(place, line))} for n, line in enumerate(found)]
        return pd.DataFrame(made, columns=[*by, "line", "points"])

    return winds.select(*by, "gy", "gx", "u", "v").dropna().groupBy(*by).applyInPandas(walk, schema)
