"""A sparse rule ensemble for text quality.

Statistics of each text are Column expressions. Small trees are grown on a bounded sample of labelled rows, each on a
bootstrap and on what the trees before leave unexplained; every path from a root to a node is a conjunctive rule. Lasso
logistic regression leaves few rules with a weight, and those become one Column expression again, so that scoring is a
projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_out, table

#: Conditions of a rule: (statistic, whether it is above, threshold).
Condition = tuple[str, bool, float]


def _left(text: Column, pattern: str) -> Column:
    """How many characters are left once runs of pattern are gone."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; a null one is empty. Shares are 0 where there is nothing to share."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    gaps = _left(t, r"\S+")
    lines = F.size(F.split(t, "\n")).cast("double")
    odd = _left(t, r"[\p{L}\p{N}\s.,;:!?'\"()-]+")
    words = gaps + 1.0
    some = F.greatest(chars, F.lit(1.0))
    return {
        "log_chars": F.log1p(chars),
        "chars_per_word": chars / words,
        "words_per_line": words / lines,
        "upper_share": _left(t, r"[^\p{Lu}]+") / some,
        "digit_share": _left(t, r"[^\p{N}]+") / some,
        "odd_share": odd / some,
        "shout_share": _left(t, r"[^!?]+") / words,
        "stop_share": _left(t, r"[^.]+") / words,
        "lone_mark_share": F.regexp_count(t, F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")) / words,
        "repeat_share": F.regexp_count(t, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")) / words,
    }


#: Their names, in the order of the samples' columns.
STATISTICS = ["log_chars", "chars_per_word", "words_per_line", "upper_share", "digit_share", "odd_share", "shout_share", "stop_share", "lone_mark_share", "repeat_share"]


@dataclass
class Rules:
    """bias + the weights of the rules that hold, as log-odds of label 1."""

    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]] = field(default_factory=list)

    def expression(self) -> Column:
        """The score, 0 to 1, over columns named as the statistics."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, above, at in rule:
                holds = holds & (F.col(name) > at if above else F.col(name) <= at)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    """Candidate thresholds: midpoints between neighbouring quantiles that differ."""
    q = np.unique(np.quantile(x, np.linspace(0, 1, most + 1)))
    return (q[1:] + q[:-1]) / 2


def _grow(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: tuple, out: list[tuple]) -> np.ndarray:
    """Splits greedily by squared error; adds each node's path to out and returns the fitted values."""
    if path:
        out.append(path)
    fit = np.full(len(r), r.mean())
    if depth == 0 or len(r) < 2 * least:
        return fit
    best = (1e-9 * len(r), None, 0.0)
    for k, at in enumerate(cuts):
        if not len(at):
            continue
        cell = np.searchsorted(at, x[:, k], "left")
        n = np.bincount(cell, minlength=len(at) + 1).cumsum()[:-1]
        s = np.bincount(cell, weights=r, minlength=len(at) + 1).cumsum()[:-1]
        ok = (n >= least) & (len(r) - n >= least)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(r) - n, 1) - r.sum() ** 2 / len(r), -1)
        if gain.max() > best[0]:
            best = (gain.max(), k, float(at[gain.argmax()]))
    if best[1] is None:
        return fit
    up = x[:, best[1]] > best[2]
    for side in (False, True):
        at = up == side
        fit[at] = _grow(x[at], r[at], cuts, depth - 1, least, (*path, (best[1], side, best[2])), out)
    return fit


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, above, at in rule:
        ok &= (x[:, k] > at) == above
    return ok


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient steps."""
    n, k = z.shape
    step = 4.0 / (np.linalg.norm(np.hstack([np.ones((n, 1)), z]), 2) ** 2 / n + 1e-12)
    b = b_old = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w = w_old = np.zeros(k)
    for i in range(steps):
        m = i / (i + 3)
        bb, ww = b + m * (b - b_old), w + m * (w - w_old)
        g = 1 / (1 + np.exp(-(bb + z @ ww))) - y
        b_old, w_old = b, w
        b = bb - step * g.mean()
        w = ww - step * (z.T @ g) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    return b, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 1e-3, seed: int = 5) -> Rules:
    """Rules from samples x (rows x STATISTICS) and labels y (0 or 1). With one label only, there is a bias and no rule.

    Without any sample the score is one half throughout.
    """
    if not len(y):
        return Rules(0.0)
    if y.min() == y.max():
        return Rules(4.0 if y[0] else -4.0)
    rng = np.random.default_rng(seed)
    cuts = [_cuts(x[:, k], 64) for k in range(x.shape[1])]
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        at = rng.integers(0, len(y), min(len(y), 4000))
        r = y - 1 / (1 + np.exp(-f))
        own: list[tuple] = []
        _grow(x[at], r[at], cuts, depth, max(5, len(at) // 400), (), own)
        paths += own
        for rule in own:  # what a leaf explains is taken off; inner nodes overlap and would be taken off twice
            if not any(o[: len(rule)] == rule and len(o) > len(rule) for o in own):
                ok = _holds(x, rule)
                p = 1 / (1 + np.exp(-f[ok]))
                f[ok] += 0.3 * np.clip((y[ok] - p).sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
    distinct: dict[bytes, tuple] = {}
    for rule in sorted(set(paths), key=lambda p: (len(p), p)):
        distinct.setdefault(np.packbits(_holds(x, rule)).tobytes(), rule)
    rules = list(distinct.values())
    z = np.stack([_holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    bias, w = _lasso(z, y.astype(float), penalty, 250)
    return Rules(float(bias), [(float(a), tuple((STATISTICS[k], above, at) for k, above, at in r)) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-6])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of docs, written once; texts stay behind. Other columns aren't read."""
    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in statistics(F.col("text")).items()]), "statistics")


def learned(stats: DataFrame, labels: DataFrame, most: int = 10_000, label: str = "quality") -> Rules:
    """Rules from at most about ``most`` labelled rows, drawn by a hash of the id from those that aren't held out.

    labels: doc_id and the label, 0 or 1; other values and nulls are left out. Only the sample comes to the driver.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    n = marks.count()
    part = min(1.0, most / max(n, 1))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(part * (1 << 20)))
    rows = stats.join(drawn, "doc_id").select(*STATISTICS, "label").toPandas()
    rows = rows.sort_values(rows.columns.tolist())  # the fit doesn't depend on the order of tasks
    return fit(rows[STATISTICS].to_numpy(float), rows["label"].to_numpy(int))


def scored(stats: DataFrame, rules: Rules, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of stats, repeated ids included."""
    return stats.select("doc_id", held_out().alias("held_out"), rules.expression().alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))
