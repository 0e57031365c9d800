"""Language identification: script ranges narrow the candidates, Viterbi labels each word.

``train`` counts character trigrams of words (runs of letters) for each label. ``predict`` scores every word of a text under each language,
admits only languages that use the word's script, and finds the cheapest labelling of the words when each change of
language costs ``switch`` nats. Runs of equal labels are the spans of mixed-language text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, held_out, let_go, quoted, sliced_by_size

BITS = 16
UNDETERMINED = "und"
#: Scripts by ranges of code points (inclusive, Unicode's blocks).
SCRIPT_RANGES = {
    "latin": [(0x0041, 0x024F), (0x0250, 0x02AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F), (0xFB13, 0xFB17)],
    "hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "syriac": [(0x0700, 0x074F)],
    "thaana": [(0x0780, 0x07BF)],
    "devanagari": [(0x0900, 0x097F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "oriya": [(0x0B00, 0x0B7F)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "sinhala": [(0x0D80, 0x0DFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "lao": [(0x0E80, 0x0EFF)],
    "tibetan": [(0x0F00, 0x0FFF)],
    "myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "hiragana": [(0x3040, 0x309F)],
    "katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "bopomofo": [(0x3100, 0x312F), (0x31A0, 0x31BF)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPTS = ["other", *SCRIPT_RANGES]
_LAST = 0x323AF


@functools.cache
def _scripts() -> np.ndarray:
    """For each code point up to _LAST, and at the end for all beyond, 0 if it is no letter and no mark on one, else its
    script's place in SCRIPTS plus 1."""
    kinds = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(_LAST + 1)])
    out = kinds.astype(np.uint8)
    for k, ranges in enumerate(SCRIPT_RANGES.values(), 2):
        for low, high in ranges:
            out[low : high + 1] = np.where(kinds[low : high + 1], k, 0)
    return np.append(out, np.uint8(0))  # what lies beyond: tags, variation selectors, private use


@dataclass
class Words:
    """The words of a batch, runs of letters and their marks: where each starts among the letters, its size, the script of
    most of its letters (of equally many, the first of SCRIPTS), and each text's first word."""

    grams: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    scripts: np.ndarray
    firsts: np.ndarray


def words_of(texts: list[str]) -> Words:
    raw = [t.lower() for t in texts]
    a = np.frombuffer(("\n" + "\n".join(raw) + "\n\n").encode("utf-32-le", "replace"), np.uint32)
    kind = _scripts()[np.minimum(a, _LAST + 1)]
    letter = kind > 0
    at = np.flatnonzero(letter)
    plain = np.where(letter, a, np.uint32(32))
    tri = plain[at - 1] * np.uint32(0x9E3779B1) ^ plain[at] * np.uint32(0x85EBCA77) ^ plain[at + 1] * np.uint32(0xC2B2AE3D)
    grams = (tri * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    first = np.flatnonzero(~letter[at - 1]) if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(at)))
    own = kind[at].astype(np.int64) - 1
    scripts = own[first] if len(at) else own
    odd = np.flatnonzero(np.add.reduceat(own, first) != scripts * sizes) if len(at) else first  # not all of one script
    for w in odd.tolist():
        scripts[w] = np.bincount(own[first[w] : first[w] + sizes[w]]).argmax()
    ends = np.cumsum([1] + [len(r) + 1 for r in raw])
    return Words(grams, first, sizes, scripts, np.searchsorted(at[first], ends))


@dataclass
class Model:
    """languages, log-probabilities of trigram buckets (2**BITS x languages) and which scripts each language uses."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", least_script_share: float = 0.001) -> Model:
    """Counts over all rows with a text and a label. What comes to the driver is the model: 2**BITS counts a language at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums: dict[str, np.ndarray] = {}
        for b in sliced_by_size(batches, 0):
            by: dict[str, list[str]] = {}
            for t, lg in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lg, []).append(t)
            for lg, texts in by.items():
                w = words_of(texts)
                got = np.concatenate([np.bincount(w.grams, minlength=1 << BITS), np.bincount(w.scripts, minlength=len(SCRIPTS))])
                sums[lg] = sums.get(lg, 0) + got
        for lg, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lg] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], ["lang", "slot", "n"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    got = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros(((1 << BITS) + len(SCRIPTS), max(1, len(languages))))
    for k, lg in enumerate(languages):
        own = got[got["lang"] == lg]
        counts[own["slot"].to_numpy(), k] = own["n"].to_numpy()
    grams, scripts = counts[: 1 << BITS], counts[1 << BITS :]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << BITS)))
    return Model(languages, logs.astype(np.float32), scripts / np.maximum(1, scripts.sum(0)) >= least_script_share)


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row of s (words x languages) when a change costs switch."""
    n, k = s.shape
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    # One label throughout is best if no excursion pays: inside for two changes, at an end for one.
    best = int(s.sum(0).argmax())
    gain = np.concatenate([[0.0], np.cumsum((np.delete(s, best, 1).max(1) - s[:, best]).astype(np.float64))])
    if (gain - np.minimum.accumulate(gain)).max() <= 2 * switch and gain.max() <= switch and (gain[-1] - gain).max() <= switch:
        return np.full(n, best)
    v, back = s[0].astype(np.float64), np.empty((n, k), np.int8 if k < 128 else np.int32)
    keep = np.arange(k)
    for i in range(1, n):
        m = int(v.argmax())
        other = v[m] - switch
        back[i] = np.where(v >= other, keep, m)
        v = np.maximum(v, other) + s[i]
    out = np.empty(n, np.int64)
    out[-1] = v.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def label(texts: list[str | None], model: Model, switch: float = 12.0) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: its language, the share of its letters labelled so, and spans (first word, end word, language).

    A null text, an empty one and one without any letter are ``und`` with score 0 and no spans; so is every text if
    nothing was learned.
    """
    w = words_of([t or "" for t in texts])
    if len(w.starts) and model.languages:
        s = np.add.reduceat(model.logs[w.grams], w.starts, axis=0)
        fits = model.uses[w.scripts]
        s = np.where(fits | ~fits.any(1, keepdims=True), s, s - 1e4)
    out = []
    for i, t in enumerate(texts):
        a, b = w.firsts[i], w.firsts[i + 1]
        if a == b or not model.languages or not any(map(str.isalpha, t or "")):
            out.append((UNDETERMINED, 0.0, []))
            continue
        path = viterbi(s[a:b], switch)
        share = np.bincount(path, weights=w.sizes[a:b], minlength=len(model.languages))
        top = int(share.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
        out.append((model.languages[top], float(share[top] / share.sum()), [(x, y, model.languages[path[x]]) for x, y in zip(cuts, cuts[1:], strict=False)]))
    return out


PREDICTED = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def predict(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] = ("doc_id",), switch: float = 12.0) -> DataFrame:
    """The columns ``carry`` of every row of docs, repeated keys included, with lang_pred, score and spans; see ``label``
    for null and empty texts.

    No other column is read; carried ones that are named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    own = [c for c in carry if c not in ("lang_pred", "score", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # of a tokenizer and its words, where one ran before
        for b in sliced_by_size(batches, len(own)):
            got = label(b.column(len(own)).to_pylist(), shared.value, switch)
            spans = pa.array([[dict(zip(("start", "end", "lang"), x, strict=True)) for x in g[2]] for g in got], span)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], [*own, "lang_pred", "score", "spans"])

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"{quoted(c)} {kinds[c]}" for c in own)
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns_of(docs, own))], docs[quoted(text)].cast("string").alias("whole")).mapInArrow(run, f"{fields}, {PREDICTED}")


def accepted(docs: DataFrame, model: Model, least: float = 0.35) -> DataFrame:
    """The rows of docs with a language that holds at least ``least`` of their letters, lang being set to it; undetermined ones go."""
    found = predict(docs, model, carry=docs.columns).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(quoted(c)) for c in docs.columns])


def learned(docs: DataFrame, key: str = "doc_id") -> Model:
    """A model from every document that isn't held out."""
    return train(docs.where(~held_out(key)))
