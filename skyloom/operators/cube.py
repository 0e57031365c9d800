"""Gridded channels through time, and what physics says about forecasts of them.

A cube holds one row for each moment and channel, with a dense array of all cells of a grid of fixed size, row by row from
the south-west. Cells that nothing is known of take the value of the nearest known cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the channels of a stack in their order, thresholds of still air and of an inversion, the scales that
# channels are divided by, and the weights of the four parts of the loss ---
CHANNELS = ("pm25", "pm10", "o3", "nox", "u_wind", "v_wind", "temp", "rh", "solar_irr", "pbl", "frp", "smoke")
STILL_MS, INVERSION_M, SEVERE = 2.0, 400.0, 300.0
SCALES = {"pm25": 500.0, "u_wind": 20.0, "v_wind": 20.0, "pbl": 2000.0}
WEIGHTS = {"mse": 1.0, "mae": 0.5, "conservation": 2.0, "inversion": 1.5}


def nearest_known(values: Column, rows: int, cols: int) -> Column:
    """array<double> of rows * cols cells, nulls filled from the cell nearest on the grid (of equally near ones the first);
    an array without any value stays as it is. What a task holds at once is one array and its distances."""

    @F.pandas_udf("array<double>")
    def fill(arrays: pd.Series) -> pd.Series:
        y, x = np.divmod(np.arange(rows * cols), cols)

        def one(values: np.ndarray | None) -> np.ndarray | None:
            if values is None:
                return None
            v = np.array(values, float)
            known, gaps = np.flatnonzero(~np.isnan(v)), np.flatnonzero(np.isnan(v))
            if len(known) and len(gaps):
                for part in np.array_split(gaps, -(-len(gaps) * len(known) // 4_000_000)):
                    far = (y[part, None] - y[known]) ** 2 + (x[part, None] - x[known]) ** 2
                    v[part] = v[known[far.argmin(1)]]
            return v

        return arrays.map(one)

    return fill(values)


def stack(values: DataFrame, rows: int, cols: int, by: str = "hour", channels: Sequence[str] = CHANNELS) -> DataFrame:
    """The cube (by, channel, place, cells, gaps) of values (by, channel, gy, gx, value).

    Every moment of ``by`` has a row for each of the channels in their order (``place`` from 0): one without any row is zero
    everywhere, one without any value stays null. Of repeated cells the mean counts; null and NaN are gaps, and ``gaps`` is
    their number before they were filled. Other channels and cells beyond the grid are left out.

    Rows are dealt by ranges of ``by``, which both aggregates and a later table by time keep: one exchange. A group's
    array is bounded by the grid.
    """
    inside = F.col("gy").between(0, rows - 1) & F.col("gx").between(0, cols - 1)
    known = values.where(F.col("channel").isin(*channels) & inside)
    spot = (F.col("gy") * cols + F.col("gx")).cast("int").alias("k")
    dealt = known.select(by, "channel", spot, F.nanvl("value", F.lit(None)).alias("value")).repartitionByRange(by)
    cell = dealt.groupBy(by, "channel", "k").agg(F.avg("value").alias("value"))
    held = cell.where("value is not null").groupBy(by, "channel").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    spine = dealt.groupBy(by).agg(F.collect_set("channel").alias("seen"))  # at most all channels
    each = spine.select(by, "seen", F.posexplode(F.array(*map(F.lit, channels))).alias("place", "channel"))
    array = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.try_element_at("m", k))
    empty = F.when(F.array_contains("seen", F.col("channel")), F.lit(None).cast("double")).otherwise(0.0)
    cells = F.when(F.col("m").isNull(), F.array_repeat(empty, rows * cols)).otherwise(array)
    out = each.join(held, [by, "channel"], "left").select(by, "channel", "place", cells.alias("c"))
    gaps = F.size(F.filter("c", lambda v: v.isNull()))
    return out.select(by, "channel", "place", nearest_known(F.col("c"), rows, cols).alias("cells"), gaps.alias("gaps"))


def fields(cube: DataFrame, cols: int, channels: Sequence[str], by: str = "hour") -> DataFrame:
    """(by, gy, gx, *channels) of a cube: a row for each cell, a column for each channel."""
    wide = cube.where(F.col("channel").isin(*channels)).groupBy(by).pivot("channel", list(channels)).agg(F.first("cells"))
    zipped = wide.select(by, F.posexplode(F.arrays_zip(*channels)).alias("k", "v"))
    return zipped.select(by, F.floor(F.col("k") / cols).cast("int").alias("gy"), (F.col("k") % cols).alias("gx"), "v.*")


def physics_losses(
    pred: DataFrame,
    truth: DataFrame,
    keys: Sequence[str] = (),
    lead: str = "lead",
    cell: Sequence[str] = ("gy", "gx"),
    scales: Mapping[str, float] = SCALES,
    weights: Mapping[str, float] = WEIGHTS,
) -> DataFrame:
    """how far forecast fields are off, and where they break what still air and an inversion allow.

    pred and truth are rows (*keys, lead, *cell, pm25, u_wind, v_wind, pbl) in physical units; the result has a row for each
    lead, and one of null lead over all: n, mse, mae, conservation, inversion, total.

    - mse and mae: over all channels of ``scales``, each divided by its scale.
    - conservation: how much less pm25 the next lead is forecast to have, on average over the cells; zero where the
      forecast wind isn't below 2 m/s or its mixing height not below 400 m. The last lead has none, nor has one whose next
      lead is missing.
    - inversion: where the truth is an inversion with pm25 above 300, the squared error, twice for too low a forecast and
      half for too high a one, on average over those cells; 0 without any.
    - total: the four by their weights, what is missing counting as 0.

    Cells that one side lacks, or whose value there is null, don't count. A next lead is found by its neighbour in the cell's own rows, so
    that both sides meet and look ahead in one exchange, by keys and cell.
    """
    names = list(scales)
    side = lambda df, s: df.select(*keys, *cell, lead, *[F.col(c).cast("double").alias(f"{x}_{c}") for x in "pt" for c in names if x == s])
    both = side(pred, "p").unionByName(side(truth, "t"), allowMissingColumns=True).repartition(*keys, *cell)
    met = both.groupBy(*keys, *cell, lead).agg(*[F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in "pt" for c in names])
    met = met.dropna(subset=[f"{s}_{c}" for s in "pt" for c in names])
    ahead = Window.partitionBy(*keys, *cell).orderBy(lead)
    nxt = F.when(F.lead(lead).over(ahead) == F.col(lead) + 1, F.lead("p_pm25").over(ahead))
    drop = F.greatest(F.lit(0.0), (F.col("p_pm25") - nxt) / scales["pm25"])
    held = (F.hypot("p_u_wind", "p_v_wind") < STILL_MS) & (F.col("p_pbl") < INVERSION_M)
    off = [(F.col(f"p_{c}") - F.col(f"t_{c}")) / scales[c] for c in names]
    miss = (F.col("t_pm25") - F.col("p_pm25")) / scales["pm25"]
    severe = (F.col("t_pbl") < INVERSION_M) & (F.col("t_pm25") > SEVERE)
    rows = met.select(
        lead,
        (sum(x * x for x in off) / len(off)).alias("mse"),
        (sum(F.abs(x) for x in off) / len(off)).alias("mae"),
        F.when(nxt.isNotNull(), F.when(held, drop).otherwise(0.0)).alias("conservation"),
        F.when(severe, F.when(miss > 0, 2.0).otherwise(0.5) * miss * miss).alias("inversion"),
    )
    means = [F.avg(c).alias(c) for c in ("mse", "mae", "conservation")]
    # A table without any cell has no row: rollup alone would give one of nulls.
    out = rows.rollup(lead).agg(F.count("*").alias("n"), *means, F.coalesce(F.avg("inversion"), F.lit(0.0)).alias("inversion")).where("n > 0")
    total = sum(w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items())
    return out.withColumn("total", total)
