"""Spans and the quality rules against references that share no code with them."""

import collections
import math
import random

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import quality, span_dedup

# spans


OTHER_STOPS = "։؟۔।॥၊။።፧፨។៕。！．？｡"


def plain_sentences(t):
    out, start, i, n = [], 0, 0, len(t)
    while i < n:
        while True:
            while i < n and t[i] not in ".!?\n" + OTHER_STOPS:
                i += 1
            j = i
            while j < n and t[j] in ".!?":
                j += 1
            if j == i or j == n or t[j].isspace():
                break
            i = j
        while i < n and t[i] in ".!?" + OTHER_STOPS:
            i += 1
        while i < n and t[i].isspace():
            i += 1
        out.append(t[start:i])
        start = i
    return out


def plain_words(t):
    """(begin, word): runs of what isn't white space; Han letters one by one."""
    return [(m.start(), m[0]) for m in regex.finditer(r"\p{Han}|[^\s\p{Han}]+", t)]


def plain_pieces(t):
    out = []
    for s in plain_sentences(t):
        words = plain_words(s)
        cuts = set()
        if len(words) >= 16:
            h = [xxhash.xxh32_intdigest(w) for _, w in words]
            for i in range(len(h) - 15):
                low = min(h[i : i + 16])
                cuts.add(words[max(k for k in range(i, i + 16) if h[k] == low)][0])
        at = sorted({0, len(s)} | cuts)
        out += [s[a:b] for a, b in zip(at, at[1:], strict=False)]
    return out


def plain_removal(rows, least):
    """For each row (doc_id, text): the pieces, and which of them go."""
    where, pieces = collections.defaultdict(set), [plain_pieces(t or "") for _, t in rows]
    for (doc, _), own in zip(rows, pieces, strict=True):
        if doc is None:
            continue
        words = [tuple(w for _, w in plain_words(p)) for p in own]
        n, spans = len(own), set()
        sizes = [len(w) for w in words]
        for i in range(n):  # the first end, and for each end the last beginning, that make up enough words
            j = next((j for j in range(i + 1, min(n, i + 4 * least) + 1) if sum(sizes[i:j]) >= least), None)
            spans |= {(i, j)} if j else set()
        for j in range(1, n + 1):
            i = next((i for i in range(j - 1, max(-1, j - 1 - 4 * least), -1) if sum(sizes[i:j]) >= least), None)
            spans |= {(i, j)} if i is not None else set()
        for i, j in spans:
            where[tuple(words[i:j])].add((doc, i, j))
    gone = collections.defaultdict(set)
    for found in where.values():
        first = min(found)[:2]
        for doc, i, j in found:
            if (doc, i) != first:
                gone[doc] |= set(range(i, j))
    return [(own, {k for k in gone[doc] if k < len(own)} if doc is not None else set()) for (doc, _), own in zip(rows, pieces, strict=True)]


def test_spans_of_awkward_documents(spark, clashing):
    """Nulls, repeated rows and ids, clashing columns, passages at any place, long sentences without a stop."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    more = []
    for i in range(30):
        own = [" ".join(word() for _ in range(rng.randint(3, 30))) + rng.choice([". ", "! ", "?! ", "\n", " ", "。", "... "]) for _ in range(rng.randint(0, 9))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), passage + rng.choice(["", ". ", "\n"]))
        more.append((100 + i, "".join(own)))
    more += [more[0], more[3], (101, more[4][1])]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = clashing.unionByName(extra, allowMissingColumns=True).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = collections.Counter()
    for (doc, text), (own, lost) in zip(rows, plain_removal(rows, 20), strict=True):
        assert "".join(own) == (text or "")
        left = None if text is None else "".join(p for k, p in enumerate(own) if k not in lost)
        want[doc, left, len(own), len(lost)] += 1
    got = span_dedup.dedup_spans(docs, parts=5)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "text", "n_sentences", "n_removed").collect()) == want
    assert sum(n for (_, _, _, lost), n in want.items() if lost) > 10
    assert set(clashing.columns) <= set(got.columns)


def test_different_words_are_hashed_once_a_slice(spark, monkeypatch):
    """Tasks cut texts of Latin letters as arrays: a word that comes again and again isn't hashed each time."""
    import types

    import pyarrow as pa

    class Rows:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, task, schema):
            self.task = task
            return self

    asked = []
    counted = types.SimpleNamespace(xxh3_128_digest=xxhash.xxh3_128_digest, xxh32_intdigest=lambda w: asked.append(w) or xxhash.xxh32_intdigest(w))
    monkeypatch.setattr(span_dedup, "xxhash", counted)
    text = " ".join(f"word{i % 10} wörter{i % 7}" for i in range(300))
    rows = span_dedup.span_keys(Rows())
    got = list(rows.task(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text])], ["doc_id", "text"])])))
    assert sum(b.num_rows for b in got) > 20
    assert len(asked) < 100


def test_pieces_cut_as_arrays_are_the_sentences():
    """Latin and other texts in any order, empty ones, stops, blanks and letters of several bytes anywhere."""
    import pyarrow as pa

    rng = random.Random(3)
    latin = ["a", "foo", "É", "über", "ł", "×", ".", " ", "  ", "\n", "\n\n", " \n", "\t", "\x0b", "...", "?!", "!", "don't", "3.14", "<b>", "ā."]
    for k in range(300):
        bits = latin if k % 3 else [*latin, "中文字", "。", "\u00a0", "\u2003", "\u0301"]
        texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ". ", "\n"]) for _ in range(rng.choice([0, 1, 3, 20, 60]))) for _ in range(rng.randint(0, 8))]
        least = rng.choice([2, 5, 20])
        sizes, counts, digests, bounds = span_dedup.cut_up(pa.array(["before", *texts], pa.string()).slice(1))
        own = [plain_pieces(t) for t in texts]
        words = [[w for _, w in plain_words(p)] for t in own for p in t]
        assert sizes.tolist() == [len(p.encode()) for t in own for p in t] and counts.tolist() == [len(w) for w in words]
        assert digests == b"".join(xxhash.xxh3_128_digest(" ".join(w)) for w in words)
        assert bounds.tolist() == [sum(map(len, own[:i])) for i in range(len(own) + 1)]
        found = list(zip(*[x.tolist() for x in span_dedup.runs_of(counts, bounds, least)], strict=True))
        assert found == [(d, bounds[d] + i, n) for d in range(len(own)) for i, n in span_dedup.runs(counts[bounds[d] : bounds[d + 1]].tolist(), least)]


def test_removed_places_count_characters(spark):
    """Letters of several bytes before and in what is removed, several places in a text, at its beginning and its end."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("äéßñxyz中") for _ in range(4))
    passages = [" ".join(word() for _ in range(60)) + ". " for _ in range(4)]
    own = lambda: " ".join(word() for _ in range(9)) + ". "
    rows = [(i, p) for i, p in enumerate(passages)] + [(10, passages[0] + own() + passages[1]), (11, own() + passages[2] + passages[3] + own()), (12, own()), (13, None), (13, own() + passages[1] + own()), (None, passages[0])]
    got = span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    lost = {}
    for r in got:
        text = next(t for k, t in rows if k == r["doc_id"] and (t is None) == (r["text"] is None) and (t is None or len(t) == len(r["text"]) + sum(x["length"] for x in r["removed"])))
        for x in reversed(r["removed"]):
            text = text[: x["start"]] + text[x["start"] + x["length"] :]
        assert text == r["text"]
        lost[r["doc_id"], r["text"] is None] = len(r["removed"])
    assert lost[10, False] == 2 and lost[11, False] in (1, 2) and lost[12, False] == 0 and lost[13, False] == 1 and lost[13, True] == 0


def test_spans_of_nothing(spark, nothing):
    assert span_dedup.dedup_spans(nothing).count() == 0
    assert span_dedup.dedup_spans(nothing).columns[-3:] == ["n_sentences", "n_removed", "removed"]


# quality


def plain_statistics(text):
    t = text or ""
    some, words = max(len(t), 1), len("".join(regex.split(r"[^ \t\n\x0b\f\r]+", t))) + 1
    count = lambda p: len(regex.findall(p, t))
    tokens = regex.findall(r"[^ \t\n\x0b\f\r]+", t)
    marks = [w for w in tokens if not regex.search(r"[\p{L}\p{N}]", w)]
    return {
        "log_chars": math.log1p(len(t)),
        "chars_per_word": len(t) / words,
        "words_per_line": words / (t.count("\n") + 1),
        "upper_share": count(r"\p{Lu}") / some,
        "digit_share": count(r"\p{N}") / some,
        "odd_share": count(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:!?'\"()\-]") / some,
        "shout_share": count("[!?]") / words,
        "stop_share": t.count(".") / words,
        "lone_mark_share": len(marks) / words,
        "repeat_share": sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / words,
    }


def test_statistics_are_what_they_say(spark):
    texts = ["", "One two two three.", "  A  b\n\nC!! ?? 12 ½ ", "ÀÉ é — … (x) \"y\" 中文 #$%", "a a a b b\ta", "no\nline\nends", "x" * 500 + " 7.5%"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = df.select("i", *[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    for r in got:
        want = plain_statistics([*texts, None][r["i"]])
        assert list(want) == quality.STATISTICS
        for k, v in want.items():
            assert r[k] == pytest.approx(v), (r["i"], k)


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x, r = rng.normal(size=(300, 3)), rng.normal(size=300)
    r[x[:, 1] > 0.4] += 1.5
    cuts = [quality._cuts(x[:, k], 16) for k in range(3)]
    out = []
    fit = quality._grow(x, r, cuts, 1, 10, (), out)
    best = None
    for k in range(3):
        for at in cuts[k]:
            up = x[:, k] > at
            if 10 <= up.sum() <= 290:
                loss = ((r[up] - r[up].mean()) ** 2).sum() + ((r[~up] - r[~up].mean()) ** 2).sum()
                best = min(best or (loss, k, at), (loss, k, at))
    assert sorted(out) == sorted([((best[1], False, best[2]),), ((best[1], True, best[2]),)])
    up = x[:, best[1]] > best[2]
    assert np.allclose(fit, np.where(up, r[up].mean(), r[~up].mean()))
    deep = []
    quality._grow(x, r, cuts, 3, 10, (), deep)
    for path in deep:  # each path holds for enough rows, and its parent is a path too
        ok = np.ones(300, bool)
        for k, above, at in path:
            ok &= (x[:, k] > at) == above
        assert ok.sum() >= 10 and (len(path) == 1 or path[:-1] in deep)


def test_the_lasso_meets_its_conditions():
    """At the minimum the gradient of a weight is the penalty against its sign, within the penalty where the weight is 0."""
    rng = np.random.default_rng(6)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2.5 * z[:, 0] - 2 * z[:, 3] - 0.3)))).astype(float)
    b, w = quality._lasso(z, y, 0.02, 5000)
    g = 1 / (1 + np.exp(-(b + z @ w))) - y
    slope = z.T @ g / len(y)
    assert abs(g.mean()) < 1e-6
    assert (abs(w) > 1e-9).sum() < 12 and w[0] > 0 > w[3]
    for s, x in zip(slope, w, strict=True):
        assert s == pytest.approx(-0.02 * np.sign(x), abs=1e-6) if abs(x) > 1e-9 else abs(s) <= 0.02 + 1e-6


def test_the_compiled_expression_is_the_sum_of_its_rules(spark):
    rng = random.Random(2)
    names = quality.STATISTICS
    rules = [(rng.uniform(-2, 2), tuple((rng.choice(names), rng.random() < 0.5, rng.random()) for _ in range(rng.randint(1, 3)))) for _ in range(25)]
    made = quality.Rules(0.3, rules)
    rows = [tuple(rng.random() for _ in names) for _ in range(60)] + [tuple(rules[k % 25][1][0][2] for _ in names) for k in range(25)]
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*names, made.expression().alias("p")).collect()
    for r in got:
        odds = 0.3 + sum(w for w, rule in rules if all((r[n] > at) == above for n, above, at in rule))
        assert r["p"] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_a_fit_finds_a_planted_rule():
    """Labels by a conjunction of two statistics, some wrong: the rules recover it on rows that weren't seen."""
    rng = np.random.default_rng(9)
    x = rng.random((4000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.3) & (x[:, 5] <= 0.8)).astype(int)
    noisy = np.where(rng.random(3000) < 0.03, 1 - y[:3000], y[:3000])
    made = quality.fit(x[:3000], noisy)
    odds = np.full(1000, made.bias)
    for w, rule in made.rules:
        ok = np.ones(1000, bool)
        for n, above, at in rule:
            ok &= (x[3000:, quality.STATISTICS.index(n)] > at) == above
        odds += w * ok
    assert ((odds > 0) == y[3000:]).mean() > 0.97 and len(made.rules) < 200


# language ID


def test_code_points_beyond_the_last_letter_are_no_letters():
    from skyloom.llm import langid

    tags = "\U000e0041\U000e0020\U000f0000\U0010fffd\U000e0100"
    words = langid.words_of([f"ab{tags}cd", tags, "\U000323af漢"])
    assert words.sizes.tolist() == [2, 2, 2]
    kinds = [langid.SCRIPTS[k] for k in words.scripts.tolist()]
    assert kinds[0] == kinds[1] != kinds[2]
