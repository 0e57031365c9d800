"""Token counts, ranked search and collocations against brute force over awkward documents."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyloom.llm import collocations, token_counts, treaps
from skyloom.llm.minimal_hash import MinimalHash

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t ", "a <|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|>", "it's \x1c x\x85y", "é ́a", "Σας ΑΣ İx", "中文字 ١٢ ½", "a b can't've 's", "x" * 3000, "🙂👍🏽 z", "don’t STOP!!1 ...a,b", "word " * 30000]


def texts_of(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(v).alias(k) for k, v in more.items()])


# token counts


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_are_the_library_s(spark, clashing, path):
    library = Tokenizer.from_file(path)
    docs = clashing.select("doc_id", "text").union(texts_of(spark, ODD).select("doc_id", "text")).withColumn("n_tokens", F.lit("x"))
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, path, limit=100).collect())
    want = collections.Counter()
    for d in docs.collect():
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        want[d["doc_id"], len((d["text"] or "").encode()), n, n > 100] += 1
    assert got == want


def test_proven_strings_are_one_token_and_spare_the_merges(spark):
    pieces, texts = token_counts.proven(WORD)
    library = Tokenizer.from_file(WORD)
    assert len(texts) > 30000
    assert all(len(e.ids) == 1 for e in library.encode_batch(sorted(texts), add_special_tokens=False))
    assert not texts & {"it's", "12", "a b", "<|endoftext|>"} and {"the", "1", "!!"} <= texts
    counts = token_counts.Counts(WORD, pieces, texts)

    class Never:
        def tokenize(self, word):
            raise AssertionError(word)

    counts.merges = Never()
    assert counts.of("The house, the time! And 1 2 3.") == len(library.encode("The house, the time! And 1 2 3.").ids)


def test_counts_forget_and_stay_right(spark):
    pieces, texts = token_counts.proven(WORD)
    counts, library = token_counts.Counts(WORD, pieces, texts, remembered=3), Tokenizer.from_file(WORD)
    for t in ("qwertz uiopas dfghjk yxcvbn", "mnbvcx qwertz.", "QWERTZ-uiopas"):
        assert counts.of(t) == len(library.encode(t).ids)


def test_counts_of_nothing_and_of_other_files(spark, nothing):
    assert token_counts.count_tokens(nothing, WORD).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(nothing, public_tokenizers.path("piece_bpe_32k.model"))


# ranked search


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [t for t in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low) if t]


def plain_search(docs, items, k):
    held = [(i, collections.Counter(t), len(t)) for i, text in docs if (t := plain_terms(text))]
    n, total = len(held), sum(x[2] for x in held)
    df = collections.Counter(t for _, tf, _ in held for t in tf)
    queries = collections.defaultdict(set)
    for item, text in items:
        queries[item] |= set(plain_terms(text))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, tf, size in held:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms & tf.keys())
            scores.append((-s, i is None, i))
        best = sorted((s for s in scores if s[0]), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(best, 1)]
    return collections.Counter(out)


def test_search_equals_scoring_every_document(spark, clashing, monkeypatch):
    rng = random.Random(4)
    docs = [(d["doc_id"], d["text"]) for d in clashing.collect()]
    full = [t for _, t in docs if t and len(t) > 40]
    items = [(i, " ".join(rng.sample(rng.choice(full).split(), 5))) for i in range(12)]
    items += [(3, "shared LINE"), (20, None), (21, ""), (22, "nowhere_else-at'all"), (23, "é中文 Wörter çà́"), (24, full[0]), (24, full[0]), (None, "shared line")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1)})
    for leaf, postings, block in ((1, 50, 30), (4, 10**6, 10**6)):
        monkeypatch.setattr(treaps, "LEAF", leaf)
        got = treaps.search(clashing.repartition(3), table, k=7, block=block, postings=postings)
        assert collections.Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == plain_search(docs, items, 7)


def test_search_of_nothing(spark, nothing):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treaps.search(nothing, items).count() == 0
    assert treaps.search(texts_of(spark, ["a b"]), items.limit(0)).count() == 0
    assert treaps.search(texts_of(spark, [None, "", "--"]), items).count() == 0


def treap_of(rng, n_docs, n_terms):
    held = [(d, t, rng.randint(1, 50)) for t in range(n_terms) for d in range(n_docs) if rng.random() < 0.6]
    return treaps.Treaps(*(np.array(x, np.int64) for x in zip(*held, strict=True)), n_docs)


def test_a_treap_is_ordered_by_document_and_by_impact():
    t = treap_of(random.Random(1), 200, 3)
    total = 0
    for root in t.root.tolist():
        seen, stack = [], [(root, -1, 200)]
        while stack:
            x, lo, hi = stack.pop()
            assert lo < t.place[x] < hi
            seen.append(x)
            for y, a, b in ((t.left[x], lo, t.place[x]), (t.right[x], t.place[x], hi)):
                if y:
                    assert t.impact[y] <= t.impact[x]
                    stack.append((y, a, b))
        assert len(set(seen)) == len(seen)
        total += len(seen)
    assert total == len(t.place) - 1


def test_subtrees_that_cannot_enter_are_left_out(monkeypatch):
    """Two documents far above all others: the walk opens a small part of the intervals that hold 4,000 documents."""
    monkeypatch.setattr(treaps, "LEAF", 8)
    n = 4000
    places = np.concatenate([np.arange(n), np.array([7, 3001])])
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(2, np.int64)])
    impacts = np.concatenate([np.arange(n) % 5 + 1, np.array([1000, 900])])
    best = treaps.Best(2)
    opened = treaps.walk(treaps.Treaps(places, terms, impacts, n), np.arange(n), np.array([0, 1]), best)
    assert best.ids.tolist() == [7, 3001] and opened < 30


# collocations


def plain_phrases(rows, least, limit, inside=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang or "und"][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in frequent.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:limit], 1)]
    return collections.Counter(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases_equal_counting_everything(spark, clashing, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 300)
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma\t", "δέλτα", "a.b", "x,", "the", "  ", "\n", "ÀÉ", "the the", "no."]
    extra = [(None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))), [None, "en", "d e\n\t"][i % 3], None, None) for i in range(60)]
    docs = clashing.select("doc_id", "text", "lang", "source", "n_chars", "score", "n", "a").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x")] * 3))
    rows = [(d["text"], d["lang"]) for d in docs.collect()]
    for share, remembered, least, limit in ((10**6, 10**6, 3, 40), (500, 20, 10, 2000)):
        monkeypatch.setattr(collocations, "SHARE", share)
        monkeypatch.setattr(collocations, "REMEMBERED", remembered)
        got = collocations.phrases(docs.repartition(3), least=least, limit=limit).select(*COLUMNS)
        want = plain_phrases(rows, least, limit)
        assert len(want) > 20 and collections.Counter(tuple(r) for r in got.collect()) == want


def test_phrases_of_nothing(spark, nothing):
    assert collocations.phrases(nothing).count() == 0
    assert collocations.phrases(texts_of(spark, [None, "", "one two"], lang=None)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 1, 10**13 + 7, 3 * 10**13 + 1), (10**12, 10**12, 10**12), (12, 17, 23)]
    df = spark.createDataFrame(rows, "a long, l1 long, r1 long").select("a", "l1", "r1", collocations._cut(1).alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l1"] * r["r1"]) for r in df.collect())


def test_word_bits_use_spark_s_hash(spark):
    words = spark.createDataFrame([("en", "one"), ("de", "zwölf"), ("und", "x" * 100)], "lang string, phrase string")
    bits = collocations.bits_of_words(words)
    coders = {lang: collocations.Coder(lang, bits) for lang in ("en", "de", "und")}
    for lang, word in [tuple(r) for r in words.collect()]:
        coders[lang].code(word.encode() + b" zweiundvierzig")
        assert coders[lang].passes.tolist() == [False, False, True, False]
    assert int(np.unpackbits(bits).sum()) == 3


def test_the_minimal_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        k1, k2 = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        k1[: n // 3] = 5  # keys that differ in one half only
        made = MinimalHash.from_bytes(MinimalHash.of(k1, k2).to_bytes())
        assert sorted(made.slots(k1, k2).tolist()) == list(range(n)) and made.size == n
        others = made.slots(k2 + np.uint64(1), k1)
        assert ((others >= -1) & (others < max(n, 1))).all()
    with pytest.raises(ValueError):
        MinimalHash.of(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))
