"""Hourly series of sensor networks: densifying, windows with least counts, quality control, filling.

Row frames count hours only on a dense spine, so what looks back by rows expects ``densify`` first. Missing is null;
NaN must be made null when a table is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: Sequence[str], hour: str = "hour", backwards: bool = False) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc(hour) if backwards else F.col(hour))


def densify(rows: DataFrame, keys: Sequence[str], hour: str = "hour", whole: bool = False) -> DataFrame:
    """A row for each hour of each key's own span, or of the whole table's, with nulls where there was none."""
    ends = rows.groupBy(*keys).agg(F.min(hour).alias("__a"), F.max(hour).alias("__b"))
    if whole:
        span = rows.agg(F.min(hour).alias("__a"), F.max(hour).alias("__b"))
        ends = ends.select(*keys).join(F.broadcast(span))  # one row
    spine = ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 1 hour"))).alias(hour))
    return spine.join(rows, [*keys, hour], "left")


def trailing_mean(value: Column, spec: WindowSpec, hours: int, least: int) -> Column:
    """The mean of the last hours rows if at least so many of them have a value."""
    frame = spec.rowsBetween(1 - hours, 0)
    return F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))


def index_window(rows: DataFrame, keys: Sequence[str], eight_hourly: Column, value: str = "value", hour: str = "hour") -> DataFrame:
    """``windowed``, what an index is computed from at every hour: the 24-hour mean, or the worst 8-hour mean that
    ended in the last 24 hours (so it looks back 31)."""
    spec = series(keys, hour)
    eight = rows.withColumn("__eight", trailing_mean(F.col(value), spec, 8, 6))
    worst = F.max("__eight").over(spec.rowsBetween(-23, 0))
    return eight.withColumn("windowed", F.when(eight_hourly, worst).otherwise(trailing_mean(F.col(value), spec, 24, 16))).drop("__eight")


def batch_window(rows: DataFrame, keys: Sequence[str], eight_hourly: Column, value: str = "value", hour: str = "hour") -> DataFrame:
    """As ``index_window``, but 8-hour means must lie wholly inside the 24 hours; with n_valid of those."""
    spec = series(keys, hour)
    day = spec.rowsBetween(-23, 0)
    eight = rows.withColumn("__eight", trailing_mean(F.col(value), spec, 8, 6)).withColumn("n_valid", F.count(value).over(day))
    mean = F.when(F.col("n_valid") >= 16, F.avg(value).over(day))
    worst = F.max("__eight").over(spec.rowsBetween(-16, 0))
    return eight.withColumn("windowed", F.when(eight_hourly, F.when(F.col("n_valid") >= 6, worst)).otherwise(mean)).drop("__eight")


def despike(rows: DataFrame, by: Sequence[str] = ("hour",), value: str = "value", least: float = 200.0, factor: float = 3.0) -> DataFrame:
    """Value becomes null where it is above ``least`` and above ``factor`` times the second highest of its group.

    Two equal maxima are each other's second; a lone value stays. The second highest comes from partial aggregates.
    """
    v = F.col(value)
    top = rows.groupBy(*by).agg(F.max(v).alias("__top"))
    with_top = rows.where(v.isNotNull()).join(top, list(by))
    second = with_top.groupBy(*by).agg(F.count_if(v == F.col("__top")).alias("__n"), F.max(F.when(v < F.col("__top"), v)).alias("__below"), F.first("__top").alias("__t"))
    second = second.select(*by, F.when(F.col("__n") > 1, F.col("__t")).otherwise(F.col("__below")).alias("__second"))
    out = rows.join(second, list(by), "left")
    bad = (v > least) & (v > F.col("__second") * factor)
    return out.withColumn(value, F.when(~F.coalesce(bad, F.lit(False)), v)).drop("__second")


def runs(rows: DataFrame, keys: Sequence[str], value: str = "value", hour: str = "hour") -> DataFrame:
    """``run`` and ``run_length`` of equal consecutive values on a dense spine; a gap is a run of its own."""
    spec = series(keys, hour)
    same = F.col(value) == F.lag(value).over(spec)
    out = rows.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    out = out.withColumn("run", F.sum("__new").over(spec.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return out.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "run")))


def drop_stuck(rows: DataFrame, keys: Sequence[str], value: str = "value", hour: str = "hour", run: int = 6, low: float = 5.0) -> DataFrame:
    """Value becomes null in runs of at least ``run`` equal hours below ``low``."""
    out = runs(rows, keys, value, hour)
    stuck = (F.col("run_length") >= run) & (F.col(value) < low)
    return out.withColumn(value, F.when(~F.coalesce(stuck, F.lit(False)), F.col(value))).drop("run", "run_length")


def _so_far(value: Column, spec: WindowSpec) -> Column:
    """The last value up to a row: a frame that only grows, so that each row is looked at once. In the opposite order of
    rows it is the first value to come, for which a frame that shrinks would begin anew with each row."""
    return F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def filled(value: Column, spec: WindowSpec, backwards: WindowSpec) -> Column:
    """The last value so far, else the first one to come. backwards: spec in the opposite order."""
    return F.coalesce(_so_far(value, spec), _so_far(value, backwards))


def interpolated(value: Column, hour: Column, spec: WindowSpec, backwards: WindowSpec) -> Column:
    """On the line between the neighbours in time; the nearest value at the ends. backwards: spec in the opposite order."""
    at = F.unix_seconds(hour.cast("timestamp"))
    known = F.when(value.isNotNull(), F.struct(at.alias("t"), value.alias("v")))
    a, b = _so_far(known, spec), _so_far(known, backwards)
    between = a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"])
    return F.when(value.isNotNull(), value).when(a.isNotNull() & b.isNotNull(), between).otherwise(F.coalesce(a["v"], b["v"]))


def worst_mean(rows: DataFrame, keys: Sequence[str], value: str = "value", hour: str = "hour", hours: int = 24) -> DataFrame:
    """The worst mean of so many consecutive rows of each key; the plain mean of fewer rows."""
    spec = series(keys, hour)
    moving = F.when(F.count(F.lit(1)).over(spec.rowsBetween(1 - hours, 0)) == hours, F.avg(value).over(spec.rowsBetween(1 - hours, 0)))
    return rows.withColumn("__m", moving).groupBy(*keys).agg(F.coalesce(F.max("__m"), F.avg(value)).alias("worst"))


def quorum(rows: DataFrame, hour: str = "hour", value: str = "value") -> DataFrame:
    """The share of rows of each hour that have a value."""
    return rows.groupBy(hour).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("share"))


def history(rows: DataFrame, keys: Sequence[str], end: Column, hours: int = 24, value: str = "value", hour: str = "hour", trim: bool = False) -> DataFrame:
    """Array of the last hours values up to end, oldest first, gaps null. With trim, hours before the first of
    any key's values go for all keys alike."""
    rows = rows.withColumn("__slot", hours - 1 - F.floor((F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(F.col(hour).cast("timestamp"))) / 3600).cast("int"))
    inside = rows.where((F.col("__slot") >= 0) & (F.col("__slot") < hours) & F.col(value).isNotNull())
    held = inside.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__slot", value))).alias("__m"))  # at most one entry a slot
    first = F.lit(0)
    if trim:
        held = held.join(F.broadcast(inside.agg(F.coalesce(F.min("__slot"), F.lit(0)).alias("__first"))))  # one row
        first = F.col("__first")
    return held.select(*keys, F.transform(F.sequence(first, F.lit(hours - 1)), lambda k: F.try_element_at("__m", k)).alias("window"))


def blocks(hours: DataFrame, hour: str = "hour", keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, start, end, length) of runs of consecutive hours, which are distinct by key. Without keys the hours are a
    calendar, not the data."""
    n = F.unix_seconds(F.col(hour).cast("timestamp")) / 3600
    islands = hours.select(*keys, hour, (n - F.row_number().over(Window.partitionBy(*keys).orderBy(hour))).cast("long").alias("__k"))
    ends = [F.min(hour).alias("start"), F.max(hour).alias("end"), F.count("*").alias("length")]
    return islands.groupBy(*keys, "__k").agg(*ends).drop("__k")


def windows_in(length: Column, size: int, stride: int) -> Column:
    """How many windows of size hours, stride apart, lie inside a block."""
    return F.when(length >= size, F.floor((length - size) / stride) + 1).otherwise(0).cast("long")


def legal_starts(runs: DataFrame, span: int, stride: int) -> DataFrame:
    """(*keys, start) of all windows of span hours, stride apart, that lie wholly inside one of the blocks."""
    last = F.col("end") - F.expr(f"interval {span - 1} hours")
    fit = runs.where(F.col("length") >= span)
    starts = F.explode(F.sequence("start", last, F.expr(f"interval {stride} hours")))
    return fit.select(*[c for c in runs.columns if c not in ("start", "end", "length")], starts.alias("start"))


def split_by_date(starts: DataFrame, span: int, low: Column, high: Column) -> DataFrame:
    """Starts with ``part``: val for windows wholly inside [low, high], train for those clear of it, null for those that
    overlap it by even one hour."""
    end = F.col("start") + F.expr(f"interval {span - 1} hours")
    inside = (F.col("start") >= low) & (end <= high)
    clear = (F.col("start") > high) | (end < low)
    return starts.withColumn("part", F.when(inside, "val").when(clear, "train"))


def split_with_gap(starts: DataFrame, span: int, fraction: float) -> DataFrame:
    """Starts with ``part``: val for the latest windows, the given fraction of all, train for those that end before the
    first of them begins, null for those between. All windows of the hour at which the fraction begins are val.

    Everything is train without a fraction or with fewer than four windows. The hour is found among the different hours, a
    calendar, with their numbers of windows.
    """
    n = starts.groupBy("start").agg(F.count("*").alias("__n"))
    so_far = F.sum("__n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0))  # an hour each
    counted = n.select("start", so_far.alias("__sum"))
    total = F.max("__sum").over(Window.partitionBy())
    cut = counted.withColumn("__all", total).where(F.col("__sum") > F.floor(F.col("__all") * (1.0 - fraction)))
    first = cut.agg(F.min("start").alias("__first"), F.max("__all").alias("__all"))  # one row
    none = F.lit(fraction <= 0) | (F.col("__all") < 4) | F.col("__first").isNull()
    ends = F.col("start") + F.expr(f"interval {span} hours")
    part = F.when(none, "train").when(F.col("start") >= F.col("__first"), "val").when(ends <= F.col("__first"), "train")
    return starts.join(F.broadcast(first)).withColumn("part", part).drop("__first", "__all")
