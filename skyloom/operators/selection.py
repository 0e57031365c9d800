"""Ranks, slices and published texts: rows chosen by counting, by nearest moment, and figures put in place of older ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of a hash that name its bucket: 65,536 buckets.
DIGITS = 4


def ranked_by_hash(rows: DataFrame, keys: Sequence[str], hashed: str, ties: str, name: str = "rank") -> DataFrame:
    """rows with their rank, from 1, in each group by a hexadecimal hash of uniform spread, equal hashes by ``ties``.

    However few groups there are, no task sorts one whole: rows are counted by the hash's first digits, at most
    16^DIGITS counts a group; their running sums say how many rows lie before a bucket, and within a bucket rows are
    sorted. Rows with a null hash come first, all in one bucket. Group keys may be null.
    """
    bucket = rows.withColumn("__b", F.coalesce(F.substring(hashed, 1, DIGITS), F.lit("")))
    counts = bucket.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.select("__before", F.struct(*keys, "__b").alias("__at"))
    placed = bucket.withColumn("__at", F.struct(*keys, "__b")).join(starts, "__at")
    inside = F.row_number().over(Window.partitionBy("__at").orderBy(hashed, ties))
    return placed.withColumn(name, F.col("__before") + inside).select(*rows.columns, name)


def nearest_slice(requests: DataFrame, times: DataFrame, at: str, valid: str, seconds: int = 3600) -> DataFrame:
    """Requests with ``valid``, the moment of times closest to their own within so many seconds, of two alike the
    earlier; null where there is none, or where the own moment is null.

    Moments meet by equality of spans as long as the tolerance, each request's in its own and the two beside it, so one join
    and one partial aggregate over different moments do it, without sorting either side.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = lambda c: F.floor(micros(c) / (seconds * 1_000_000))
    asked = requests.select(at).dropna().distinct()
    asked = asked.withColumn("__s", F.explode(F.array(*[span(at) + d for d in (-1, 0, 1)])))
    there = times.select(valid).dropna().distinct().withColumn("__s", span(valid))
    gap = F.abs(micros(valid) - micros(at))
    met = asked.join(there, "__s").where(gap <= seconds * 1_000_000)
    best = met.groupBy(at).agg(F.min(F.struct(gap.alias("g"), valid)).alias("__t")).select(at, F.col(f"__t.{valid}").alias(valid))
    return requests.drop(valid).join(best, at, "left")


def patched(text: Column, pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Struct (text, refused): each old figure replaced by its new one, in turn; ``refused`` is the first old one that the
    text doesn't hold exactly once, and then the text stays as it was, for a stale figure is worse than a stop.

    An old figure equal to its new one is passed over. Hits are counted without overlaps. With a null or empty old figure, a null new
    one or a null text nothing is replaced: the old one, or an empty string for a null, is what is refused.
    """
    step = F.struct(text.alias("text"), F.lit(None).cast("string").alias("refused"))
    for old, new in pairs:
        now = step["text"]
        hits = F.try_divide(F.length(now) - F.length(F.replace(now, old, F.lit(""))), F.length(old))
        fine = F.coalesce((hits == 1) & new.isNotNull(), F.lit(False))
        same = F.coalesce(old == new, F.lit(False))
        refused = F.coalesce(step["refused"], F.when(~same & ~fine, F.coalesce(old, F.lit(""))))
        put = F.when(~same & fine & refused.isNull(), F.replace(now, old, new)).otherwise(now)
        step = F.struct(put.alias("text"), refused.alias("refused"))
    return F.struct(F.when(step["refused"].isNull(), step["text"]).otherwise(text).alias("text"), step["refused"].alias("refused"))
