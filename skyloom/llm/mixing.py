"""Mixing of sources to target weights by iterative proportional fitting, by DataFrame functions only.

Token counts are summed up by cell (source, language, topic). Targets are tempered, but never above what a value holds: the
rest is shared out among the others. The cells' weights are raked: scaled to the target of each source, then of each
language, then of each topic, round after round until they have settled, never above what a cell holds. A document is
sampled with its cell's weight by its cell's tokens as probability, decided by a hash of its id.

Up to ``FOLD`` cells, combinations of labels, are counted and then gathered in one row, and all rounds are one fold over
arrays: a step costs as much as there are cells. More cells stay rows: a round is then three sums by a dimension, joined
back, and a written table. Both rake alike.

Documents without a topic are left out of the topic step; ``marginals`` reports what is wanted and what comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, union_all

DIMENSIONS = ("source", "lang", "topic")
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Dimensions in which null is no value: such documents have no target there.
OPEN = ("topic",)
#: Rounds after which weights have settled, and steps that then scale all to the share of all tokens.
SETTLED, FINAL = 300, 40
#: Cells that are raked in one row, and the change of a weight, by its cell's tokens, below which more cells have settled.
FOLD, STILL = 5_000, 1e-7


def words(text: Column) -> Column:
    """The number of runs of non-blank characters; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def rake(cells: DataFrame, targets: dict[str, DataFrame], share: float, rounds: int = SETTLED, final: int = FINAL, fold: int = FOLD) -> DataFrame:
    """cells with weight: their tokens scaled to the targets of each dimension in turn, at most all of a cell.

    cells: the dimensions and tokens, a row for each combination; nulls are a value of their own. targets: for each
    dimension its values and target tokens; a value without a target keeps its weight. In the end ``final`` steps scale
    all weights to the share of all tokens, for the caps of the cells may leave less.
    """
    few = cells.limit(fold + 1).count() <= fold
    return _raked_in_a_row(cells, targets, share, rounds, final) if few else _raked_by_joins(cells, targets, share, rounds, final)


def _raked_by_joins(cells: DataFrame, targets: dict[str, DataFrame], share: float, rounds: int, final: int) -> DataFrame:
    """Raking of many cells: each sum is a partial aggregate, each round a written table, until no weight moves."""
    have = F.coalesce(F.col("tokens").cast("double"), F.lit(0.0))
    now = table(cells.withColumns({"__have": have, "weight": have * share}), "raked")

    def scaled(rows: DataFrame, sums: DataFrame, same: Column | None) -> DataFrame:
        factor = F.when(F.col("__sum") > 0, F.coalesce(F.col("__target") / F.col("__sum"), F.lit(1.0))).otherwise(1.0)
        met = rows.join(sums, same, "left") if same is not None else rows.join(F.broadcast(sums))  # one row
        return met.withColumn("weight", F.least("__have", F.col("weight") * F.coalesce(factor, F.lit(1.0)))).select(*rows.columns)

    def settled(nxt: DataFrame) -> tuple[DataFrame, bool]:
        nxt = table(nxt, "raked")
        most = F.max(F.abs(F.col("weight") - F.col("__before")) / F.greatest("__have", F.lit(1.0)))
        return nxt.drop("__before"), (nxt.agg(most.alias("m")).first()["m"] or 0.0) < STILL

    for _ in range(rounds):
        nxt = now.withColumn("__before", F.col("weight"))
        for d, t in targets.items():
            sums = nxt.groupBy(F.col(d).alias("__value")).agg(F.sum("weight").alias("__sum"))
            wanted = t.select(F.col(d).alias("__wanted"), F.col("target").alias("__target"))
            sums = sums.join(wanted, F.col("__value").eqNullSafe(F.col("__wanted")), "left").drop("__wanted")
            nxt = scaled(nxt, sums, F.col(d).eqNullSafe(F.col("__value")))
        now, still = settled(nxt)
        if still:
            break
    for _ in range(final):
        whole = now.agg(F.sum("weight").alias("__sum"), (F.sum("__have") * share).alias("__target"))
        now, still = settled(scaled(now.withColumn("__before", F.col("weight")), whole, None))
        if still:
            break
    return now.select(*cells.columns, "weight")


def _raked_in_a_row(cells: DataFrame, targets: dict[str, DataFrame], share: float, rounds: int, final: int) -> DataFrame:
    """Raking of few cells: all of them in one row, all rounds in one fold."""
    names, coded = list(targets), cells
    for k, d in enumerate(names):  # each value of a dimension gets a number
        values = cells.select(d).distinct().join(targets[d].select(F.col(d).alias("__wanted"), F.col("target").alias(f"__target{k}")), F.col(d).eqNullSafe(F.col("__wanted")), "left")
        values = values.select(F.col(d).alias("__value"), f"__target{k}", (F.row_number().over(Window.orderBy(d)) - 1).alias(f"__code{k}"))
        coded = coded.join(values, F.col(d).eqNullSafe(F.col("__value"))).drop("__value")
    every = range(len(names))
    codes = F.array(*[F.col(f"__code{k}") for k in every], F.lit(0))
    wanted = F.array(*[F.col(f"__target{k}") for k in every], F.lit(None).cast("double"))
    cell = F.struct(codes.alias("codes"), wanted.alias("targets"), F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"), F.struct(*[F.col(c) for c in cells.columns]).alias("cell"))
    row = coded.agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    row = row.withColumn("all", F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["tokens"]) * F.lit(share))
    row = row.withColumn("widths", F.transform(F.sequence(F.lit(1), F.lit(len(names) + 1)), lambda d: F.aggregate("cells", F.lit(0), lambda a, c: F.greatest(a, F.element_at(c["codes"], d) + 1))))
    # For each dimension and each of its values the places of its cells: a step then looks at each cell once.
    places = F.when(F.size("cells") > 0, F.sequence(F.lit(1), F.size("cells"))).otherwise(F.array().cast("array<int>"))
    of = lambda d, v: F.filter(places, lambda i: F.element_at(F.element_at("cells", i)["codes"], d) == v)
    values = lambda d: F.sequence(F.lit(0), F.element_at("widths", d) - 1)
    row = row.withColumn("groups", F.transform(F.sequence(F.lit(1), F.lit(len(names) + 1)), lambda d: F.transform(values(d), lambda v: of(d, v))))
    row = table(row, "cells-in-a-row")
    each = F.lit(len(names))
    dimension = lambda step: F.when(step < each * rounds, F.pmod(step, each)).otherwise(each).cast("int") + 1

    def summed(weights: Column, d: Column) -> Column:
        own = lambda g: F.aggregate(g, F.lit(0.0), lambda a, i: a + F.element_at(weights, i))
        return F.transform(F.element_at("groups", d), own)

    def scaled(weights: Column, sums: Column, d: Column) -> Column:
        def one(c: Column, w: Column) -> Column:
            have, want = F.element_at(sums, F.element_at(c["codes"], d) + 1), F.when(d > each, F.col("all")).otherwise(F.element_at(c["targets"], d))
            return F.least(c["tokens"], w * F.when(have > 0, F.coalesce(want / have, F.lit(1.0))).otherwise(1.0))

        return F.zip_with("cells", weights, one)

    def step(state: Column, k: Column) -> Column:  # sums first, then what follows from them
        d, sums, first = dimension(F.floor(k / 2)), state["sums"], F.pmod(k, F.lit(2)) == 0
        weights = F.when(first, state["weights"]).otherwise(scaled(state["weights"], sums, d))
        return F.struct(weights.alias("weights"), F.when(first, summed(state["weights"], d)).otherwise(sums).alias("sums"))

    start = F.struct(F.transform("cells", lambda c: c["tokens"] * F.lit(share)).alias("weights"), F.array().cast("array<double>").alias("sums"))
    steps = F.sequence(F.lit(0), F.lit(2 * (len(names) * rounds + final) - 1))
    fitted = row.select("cells", F.aggregate(steps, start, step, lambda s: s["weights"]).alias("weights"))
    return table(fitted.select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).select("x.cells.cell.*", F.col("x.weights").alias("weight")), "raked")


def chance(key: Column, seed: str) -> Column:
    """A number from 0 to below 1 that depends on key and seed alone."""
    return F.conv(F.left(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def sampled(rows: DataFrame, raked: DataFrame, share: float, seed: str, dimensions: Sequence[str]) -> DataFrame:
    """rows with the probability of their cell, weight by tokens, and whether they are kept."""
    fit = raked.select(*[F.col(d).alias(f"__{d}") for d in dimensions], F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(share)).alias("probability"))
    same = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in dimensions]
    out = rows.join(fit, same, "left").drop(*[f"__{d}" for d in dimensions])
    return out.withColumn("kept", chance(F.col("doc_id"), seed) < F.col("probability"))


def attainable(cells: DataFrame, dimension: str, share: float, exponent: float) -> DataFrame:
    """(dimension, target): ``share`` of all tokens, split in proportion to each value's tokens to the power ``exponent``.
    No target is above what its value holds: the rest goes to values with room, in the same proportion. Nulls of OPEN
    dimensions have no target."""
    here = cells.where(F.col(dimension).isNotNull()) if dimension in OPEN else cells
    sums = table(here.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("have")).where("have > 0"), "sums")
    wanted = F.pow("have", F.lit(exponent))
    scale, seen = 0.0, -1
    while True:  # the scale grows, and so do the values that are taken whole
        whole = F.col("have") <= wanted * F.lit(scale)
        r = sums.agg(F.sum("have"), F.count_if(whole), F.sum(F.when(whole, F.col("have")).otherwise(0.0)), F.sum(F.when(~whole, wanted).otherwise(0.0))).first()
        if not r[0] or r[1] == seen or not r[3]:
            break
        scale, seen = (r[0] * share - r[2]) / r[3], r[1]
    return sums.select(dimension, F.least("have", wanted * F.lit(scale)).alias("target"))


def fitted(rows: DataFrame, share: float, exponents: dict[str, float] | None, dimensions: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The cells of rows with settled weights, and the targets of each dimension."""
    cells = table(rows.groupBy(*dimensions).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")), "cells")
    targets = {d: attainable(cells, d, share, (exponents or {}).get(d, 0.5)) for d in dimensions}
    return rake(cells, targets, share), targets


def mix_attainable(docs: DataFrame, share: float = 0.5, exponents: dict[str, float] | None = None, seed: str = "mix", dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """A row for each of docs (doc_id and the dimensions, tokens): these columns, probability and kept.

    exponents: how each dimension's target is tempered, 0.5 where none is given: 1 keeps the present mixture, 0 makes all
    values alike. A cell without tokens has probability ``share``. Rows that repeat an id share its fate if they are in one
    cell. Null dimensions are a value of their own, but for a topic, which documents may lack.
    """
    rows = table(docs.select("doc_id", *dimensions, "tokens"), "token-counts")
    raked, _ = fitted(rows, share, exponents, dimensions)
    return sampled(rows, raked, share, seed, dimensions)


def marginals(docs: DataFrame, share: float = 0.5, exponents: dict[str, float] | None = None, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(dimension, value, tokens, wanted, achieved): what ``mix_attainable`` wants of each value and what its weights come to."""
    raked, targets = fitted(docs, share, exponents, dimensions)
    out = []
    for d, t in targets.items():
        sums = raked.groupBy(F.col(d).alias("__value")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("achieved"))
        both = sums.join(t, F.col("__value").eqNullSafe(F.col(d)), "left")
        out.append(both.select(F.lit(d).alias("dimension"), F.col("__value").cast("string").alias("value"), "tokens", F.col("target").alias("wanted"), "achieved"))
    return union_all(out)


def with_topics(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of docs: the topic is the label of the vector of that id, null without one.

    Of several labels of one vec_id the least counts.
    """
    topics = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("__vec")).agg(F.min("label").alias("topic"))
    rows = docs.select("doc_id", "source", "lang", words(F.col("text")).alias("tokens"))
    return rows.join(topics, F.col("doc_id") == F.col("__vec"), "left").select("doc_id", "source", "lang", "topic", "tokens")
