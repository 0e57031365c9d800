"""Token counts of whole texts by a whole-token shortcut: most words are counted without being encoded.

Offline, on the driver, every string of the vocabulary is put through the library's own normaliser, splitter and merges.
Those that come out as one pre-token and one token are proven: wherever such a pre-token occurs, it is one token. Tasks
count proven pre-tokens by a look-up; merges run for the rest only. The proven strings are part of the vocabulary, so
what is broadcast is bounded by the vocabulary file, whatever the corpus.

Texts are cut at single blanks, tabs and line ends where the vocabulary drops white space (none of its pre-tokens holds
any); other vocabularies get whole texts. A part that holds the text of a special token goes to the library as it is.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use every core

from tokenizers import Tokenizer, decoders  # noqa: E402

from .shared import held_by_worker, sliced  # noqa: E402

#: Longer parts of texts aren't remembered.
LONGEST = 64


def _normal(tokenizer: Tokenizer, text: str) -> str:
    return tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text


def _pieces(tokenizer: Tokenizer, text: str) -> list[str]:
    """The pre-tokens of a text, in the vocabulary's spelling of bytes."""
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(_normal(tokenizer, text))]


def proven(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """(pre-tokens, texts): pre-tokens in the vocabulary's spelling that merge to one token, and the texts that consist of
    exactly one such pre-token and are their own normal form."""
    tokenizer = Tokenizer.from_file(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    spelled = decoders.ByteLevel()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pieces, texts = set(), set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if not token.endswith(suffix) or token in special:
            continue
        piece = token.removesuffix(suffix) if suffix else token
        if not piece or len(tokenizer.model.tokenize(piece)) != 1:
            continue
        pieces.add(piece)
        text = spelled.decode([piece])
        if _normal(tokenizer, text) == text and _pieces(tokenizer, text) == [piece]:
            texts.add(text)
    return frozenset(pieces), frozenset(texts)


class Counts:
    """Numbers of tokens; remembers at most so many parts of texts besides the proven ones."""

    def __init__(self, path: str, pieces: frozenset[str], texts: frozenset[str], remembered: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.pieces, self.texts, self.remembered = pieces, texts, remembered
        added = self.tokenizer.get_added_tokens_decoder().values()
        flags = re.IGNORECASE if any(t.normalized for t in added) else 0
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)", flags)
        self.drops_blanks = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = dict.fromkeys(self.texts, 1) | {"": 0}

    def _word(self, word: str) -> int:
        """Of ASCII letters only: in lower case it is its own normal form and one pre-token."""
        word = word.lower()
        return 1 if word in self.pieces else len(self.merges.tokenize(word))

    def _part(self, part: str) -> int:
        stem = part.rstrip(string.punctuation)
        if self.drops_blanks and stem.isascii() and stem.isalpha() and not self.special.search(part):
            tail = part[len(stem) :]
            return self._word(stem) + (self.of_part(tail) if tail else 0)
        if self.special.search(part):
            return len(self.tokenizer.encode(part, add_special_tokens=False).ids)
        found = _pieces(self.tokenizer, part)
        rest = [p for p in found if p not in self.pieces]
        return len(found) - len(rest) + sum(len(self.merges.tokenize(p)) for p in rest)

    def of_part(self, part: str) -> int:
        n = self.known.get(part)
        if n is None:
            n = self._part(part)
            if len(part) <= LONGEST:
                self.known[part] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.drops_blanks:
            return self._part(text)
        if len(self.known) > self.remembered + len(self.texts):
            self.forget()
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = list(map(self.known.get, parts))
        if None in found:
            return sum(self.of_part(p) if n is None else n for p, n in zip(parts, found, strict=True))
        return sum(found)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text): the library's count of its whole text.

    ``path`` is a vocabulary file of the tokenizers library. A null text counts as an empty one: no bytes, no tokens. Rows
    with repeated or null ids each give their own row; other columns of docs are neither read nor returned. One scan
    without a shuffle; an empty table gives an empty result.
    """
    if not path.endswith(".json"):
        raise ValueError("whole tokens can be proven for files of the tokenizers library (.json) only")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(proven(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held_by_worker(f"token counts {path}", lambda: Counts(path, *shared.value))
        for b in sliced(batches, 500):
            n = [counts.of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
