"""Fire detections: clusters, regions, thinning, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import tables as T
from ..functions.parse import detected_at
from ..sources.scratch import written


def _histogram(name: str) -> Column:
    """A map of values to counts from the combinations (values, pixels) of a cell; nulls aren't counted."""
    pairs = F.filter("__parts", lambda p: p[name].isNotNull())
    values = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[name])))
    count = lambda v: F.aggregate(F.filter(pairs, lambda p: p[name] == v), F.lit(0).cast("long"), lambda n, p: n + p["__pixels"])
    return F.when(F.size(values) > 0, F.map_from_arrays(values, F.transform(values, count)))


def clusters(
    pixels: DataFrame, cell: float = 0.25, most: int = 24, histograms: Sequence[str] = ("confidence",), now: Column | None = None
) -> DataFrame:
    """Cells with their weighted centre, strongest first: ``listed`` ones have two pixels and a rank up to ``most``.

    Each column of histograms becomes a map of its values to counts; with ``now``, age_h is the age of the newest pixel.
    Pixels are read once: partial sums by cell and combination of the histograms' values (few, for those are kinds) are summed up
    by cell, and the cells, which the region bounds, are written for what looks at all of them.
    """
    at = detected_at(F.col("acq_date"), F.col("acq_time"))
    y, x = F.floor(F.col("lat") / cell), F.floor(F.col("lon") / cell)
    w = F.col("frp")
    sums = {"pixels": F.count("*"), "frp_total": F.sum(w), "__lat": F.sum(F.col("lat") * w), "__lon": F.sum(F.col("lon") * w)}
    tops = {"frp_max": F.max(w), "newest": F.max("__at")}
    keyed = pixels.withColumns({"cy": y, "cx": x, "__at": at})
    parts = keyed.groupBy("cy", "cx", *histograms).agg(*[c.alias(k) for k, c in (sums | tops).items()])
    cells = parts.groupBy("cy", "cx").agg(
        *[F.sum(k).alias(k) for k in sums],
        *[F.max(k).alias(k) for k in tops],
        F.collect_list(F.struct(*histograms, F.col("pixels").alias("__pixels"))).alias("__parts"),
    )
    centre = {"lat": F.col("__lat") / F.col("frp_total"), "lon": F.col("__lon") / F.col("frp_total")}
    cells = cells.where("frp_total > 0").withColumns(centre | {name: _histogram(name) for name in histograms})
    columns = ["cy", "cx", "pixels", "frp_total", "frp_max", "lat", "lon", "newest", *histograms]
    cells = written(cells.select(*columns), "fire-cells")
    if now is not None:
        cells = cells.withColumn("age_h", (F.unix_seconds(now) - F.unix_seconds(F.col("newest").cast("timestamp"))) / 3600)
    total = cells.agg(F.sum("frp_total").alias("__all"))
    out = cells.join(F.broadcast(total)).withColumn("share_pct", F.col("frp_total") / F.col("__all") * 100).drop("__all")  # one row
    kept = out.where("pixels >= 2").orderBy(F.desc("frp_total"), "cy", "cx").limit(most).select("cy", "cx", F.lit(True).alias("__kept"))
    out = out.join(F.broadcast(kept), ["cy", "cx"], "left").withColumn("listed", F.coalesce("__kept", F.lit(False))).drop("__kept")  # ``most`` rows
    band, state = G.latitude_band(F.col("lat")), G.rough_state(F.col("lat"), F.col("lon"))
    return out.withColumns({"band": band, "state": state, "dist_km": G.haversine_km(F.col("lat"), F.col("lon"), *T.TARGET)})


def others(found: DataFrame) -> DataFrame:
    """What isn't listed, rolled up, so that totals close."""
    rest = found.where("not listed")
    return rest.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("pixels"), F.lit(0)).alias("pixels"), F.coalesce(F.sum("frp_total"), F.lit(0.0)).alias("frp_total"), F.count_if(F.col("pixels") < 2).alias("isolated"))


def regions(pixels: DataFrame) -> DataFrame:
    """By latitude band and rough state."""
    km = G.haversine_km(F.col("lat"), F.col("lon"), *T.TARGET)
    by = pixels.withColumn("band", G.latitude_band(F.col("lat"))).withColumn("state", G.rough_state(F.col("lat"), F.col("lon"))).withColumn("km", km)
    return by.groupBy("band", "state").agg(F.count("*").alias("pixels"), F.sum("frp").alias("frp_total"), F.max("frp").alias("frp_max"), F.min("km").alias("nearest_km"), F.avg("km").alias("mean_km"))


def thinned(pixels: DataFrame, most: int, cell: float = 0.05) -> DataFrame:
    """The strongest pixel of each small cell, then the strongest of those; all if there are no more than ``most``."""
    if pixels.limit(most + 1).count() <= most:
        return pixels
    order = F.struct(F.col("frp"), (-F.col("lat")).alias("a"), (-F.col("lon")).alias("b"), F.struct(*pixels.columns).alias("row"))
    best = pixels.groupBy(F.floor(F.col("lat") / cell).alias("ty"), F.floor(F.col("lon") / cell).alias("tx")).agg(F.max(order).alias("t"))
    return best.select("t.row.*").orderBy(F.desc("frp"), "lat", "lon").limit(most)
