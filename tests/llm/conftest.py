import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, alphabet="abcdefghij"):
    out, word = [], lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7)))
    while n > 0:
        k = min(n, rng.randint(4, 12))
        out.append(" ".join(word() for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, exact and near copies, repeated rows and ids."""
    rng = random.Random(8)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts = list(base)
    for t in base[:15]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += base[3:6]
    texts += [None, "", " \n\t ", "\n\n\n", "word", "Zwei Wörter", "ÀÉÎ çà́ \U0001f642 中文 ١٢", prose(rng, 20000), "Shared line of some length.\nown one\nshared LINE of some length. ", "x\nShared line of some length.", "a b c d e f " * 400]
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], [None, "s1", "s2"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (5, "other text under a used id", "en", "s1", 3), (None, "no id at all here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with extra columns named like what operators make."""
    from pyspark.sql import functions as F

    out = awkward
    for c in ("n_lines", "n_dropped", "lang_pred", "score", "spans", "n", "id", "a", "b", "component", "kept", "part", "removed", "node", "tokens", "range", "label", "a.b", "__doc", "key", "salt", "c0", "f0", "tick`ed"):
        out = out.withColumn(c, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
