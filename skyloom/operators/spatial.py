"""Grids, inverse-distance fields and plumes. A grid is of fixed size: 5,600 cells whatever the data."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from . import matching as M
from .fields import MOST_CELLS


def grid(spark: SparkSession, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """gy, gx, lat, lon of evenly spaced lines, both ends included."""
    g = T.GRID
    rows, cols = rows or g["rows"], cols or g["cols"]
    cell = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("gy"), (F.col("id") % cols).cast("int").alias("gx"))
    return cell.select("gy", "gx", (F.lit(g["south"]) + F.col("gy") * ((g["north"] - g["south"]) / (rows - 1))).alias("lat"), (F.lit(g["west"]) + F.col("gx") * ((g["east"] - g["west"]) / (cols - 1))).alias("lon"))


def nearest_stations(cells: DataFrame, stations: DataFrame, k: int = 8, power: float = 2.0, keys: Sequence[str] = ("gy", "gx")) -> DataFrame:
    """The k stations nearest to each cell, with raw weights 1 / distance ** power; ties by id."""
    km = F.when(F.col("km") == 0, 1e-13).otherwise(F.col("km"))
    return M.neighbours(cells, stations, k, keys).withColumn("weight", 1 / F.pow(km, F.lit(power)))


def weighted(weights: DataFrame, values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Each cell's weighted mean over the stations of weights that have a value; null if none has.

    Silent stations drop out and the others' weights are renormalised; fill values first for the other rule.
    """
    v = values.where(F.col(value).isNotNull())
    return weights.join(v, "id").groupBy(*by).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value))


def arrays_of(cells: DataFrame) -> pd.DataFrame:
    """A grid's cells (gy, gx, lat, lon) as tasks hold them; an error if there are more than a task adds up in arrays."""
    at = cells.select("gy", "gx", "lat", "lon").limit(MOST_CELLS + 1).toPandas()
    if len(at) > MOST_CELLS:
        raise ValueError(f"the grid has more than the {MOST_CELLS} cells that a task adds up in arrays")
    return at


def softened(cells: DataFrame, values: DataFrame, soft: float = 0.01) -> DataFrame:
    """(gy, gx, value): each cell's mean of all values (lat, lon, value), weighted by 1 / (km^2 + soft).

    Each task adds its values up in arrays of all cells; a row for each cell leaves it.
    """
    at = arrays_of(cells)
    lat, lon = at["lat"].to_numpy(), at["lon"].to_numpy()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight, seen = np.zeros(len(at)), np.zeros(len(at)), False
        for batch in batches:
            for i in range(0, len(batch), 256):
                b, seen = batch.iloc[i : i + 256], True
                dy, dx = (b["lat"].to_numpy()[:, None] - lat) * T.KM_LAT, (b["lon"].to_numpy()[:, None] - lon) * T.KM_LON
                w = 1 / (dy * dy + dx * dx + soft)
                total, weight = total + b["value"].to_numpy() @ w, weight + w.sum(0)
        if seen:
            yield pd.DataFrame({"gy": at["gy"], "gx": at["gx"], "total": total, "weight": weight})

    kinds = dict(cells.dtypes)
    known = values.select("lat", "lon", F.col("value").cast("double").alias("value")).dropna()
    parts = known.mapInPandas(add, f"gy {kinds['gy']}, gx {kinds['gx']}, total double, weight double")
    return parts.groupBy("gy", "gx").agg((F.sum("total") / F.sum("weight")).alias("value"))


def plume(cells: DataFrame, fires: DataFrame, u: float, v: float, sigma: float = 45.0, decay: float = 200.0, reference: float = 2.0, horizon_h: float = 72.0, calm: float = 0.5, factor: float = 0.22) -> DataFrame:
    """Frp and smoke of each cell, summed over all fires: what burns near it, and what the wind carries to it.

    cells is a grid of fixed size and goes to every task as arrays; fires at one place are summed first, each task adds up
    its fires' fields, and only one row for each cell leaves it. No fires give no rows.
    """
    at, speed = arrays_of(cells), math.hypot(u, v)
    lat, lon = at["lat"].to_numpy(), at["lon"].to_numpy()

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frp, smoke, seen = np.zeros(len(at)), np.zeros(len(at)), False
        for batch in batches:
            for i in range(0, len(batch), 256):
                f, seen = batch.iloc[i : i + 256], True
                dx, dy = (lon - f["lon"].to_numpy()[:, None]) * T.KM_LON, (lat - f["lat"].to_numpy()[:, None]) * T.KM_LAT
                near = np.exp(-(dx * dx + dy * dy) / (2 * sigma**2))
                if speed < calm:
                    weight = near / (1 + np.hypot(dx, dy) / decay) * (reference / calm)
                else:
                    along, across = dx * (u / speed) + dy * (v / speed), dy * (u / speed) - dx * (v / speed)
                    carried = (along > 0) & (along / (speed * 3.6) <= horizon_h)
                    weight = np.where(carried, np.exp(-(across * across) / (2 * sigma**2)) / (1 + np.maximum(along, 0) / decay), 0.0) * (reference / speed)
                frp, smoke = frp + f["frp"].to_numpy() @ near, smoke + f["frp"].to_numpy() @ weight
        if seen:
            yield pd.DataFrame({"gy": at["gy"], "gx": at["gx"], "frp": frp, "smoke": smoke})

    places = fires.dropna(subset=["lat", "lon", "frp"]).groupBy("lat", "lon").agg(F.sum("frp").alias("frp"))
    # Few bytes, much work: dealt to all cores, which Spark would not do by size.
    parts = places.repartition(fires.sparkSession.sparkContext.defaultParallelism).mapInPandas(fields, "gy int, gx int, frp double, smoke double")
    return parts.groupBy("gy", "gx").agg((F.sum("frp") * factor).alias("frp"), (F.sum("smoke") * factor).alias("smoke"))


def left_out(stations: DataFrame, values: DataFrame, by: str = "hour", k: int = 8) -> DataFrame:
    """Each station's value beside what its k nearest others make of it (renormalised) and the nearest reporting one's."""
    top = M.neighbours(stations.select(F.col("id").alias("a"), "lat", "lon"), stations, k, ["a"], apart=True)
    w = top.select("a", "id", "rank", (1 / F.pow(F.greatest("km", F.lit(1e-9)), F.lit(2.0))).alias("weight"))
    got = w.join(values.where("value is not null"), "id").groupBy("a", by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("idw"), F.min(F.struct("rank", "value")).alias("n"))
    return values.select(F.col("id").alias("a"), by, F.col("value").alias("truth")).join(got, ["a", by], "left").select(F.col("a").alias("id"), by, "truth", "idw", F.col("n.value").alias("nearest"))


def block_alerts(field: DataFrame, isi: str, threshold: float, height: int = 7, width: int = 8, most: int = 10, rows: int = 70, cols: int = 80, extremes: Sequence[Column] = ()) -> DataFrame:
    """Blocks of cells whose mean index reaches the threshold, the first ``most`` in scan order, with the cell of
    the highest index (of equals the first) and further aggregates, such as the most dust and the least mixing height.

    As published, the last row and column of blocks are never scored.
    """
    b = field.withColumn("bi", F.floor(F.col("gy") / height).cast("int")).withColumn("bj", F.floor(F.col("gx") / width).cast("int"))
    b = b.where((F.col("bi") * height < rows - height) & (F.col("bj") * width < cols - width))
    top = F.max(F.struct(F.col(isi), (-F.col("gy")).alias("y"), (-F.col("gx")).alias("x")))
    mean = b.groupBy("bi", "bj").agg(F.avg(isi).alias("isi"), top.alias("t"), *extremes).where(F.col("isi") >= threshold)
    return mean.withColumn("top_gy", -F.col("t.y")).withColumn("top_gx", -F.col("t.x")).drop("t").orderBy("bi", "bj").limit(most)
