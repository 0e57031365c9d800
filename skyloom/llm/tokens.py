"""Exact tokenization of whole texts by the tokenizers library, piece by piece.

Both kinds of vocabulary file split a text before they merge, and never across a single blank or line feed that a plain
character follows, nor across the end of a word that a full stop or comma follows. Texts are cut at those places, about 1 MB
at once as arrays of bytes; each different piece of these goes to the library once, and its ids are remembered. A text with
any other pattern of white space goes to the library cut only where that can't matter. Special tokens' texts count as those
tokens, as the library has it.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use every core

from tokenizers import Tokenizer, normalizers, pre_tokenizers  # noqa: E402

from .shared import held_by_worker, sliced_by_size  # noqa: E402

#: Characters that are neither white space nor combining in any engine: printable ASCII and Latin letters with marks.
PLAIN = "!-~¡-¬®-˿"
_CUT = re.compile(f"(?= [{PLAIN}])")
_STARTS_PLAIN = re.compile(f"\n?[{PLAIN}]")
_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_BREAKS, _PUNCTUATION, _ALPHANUMERIC = (np.isin(np.arange(256), list(x.encode())) for x in (" \n", string.punctuation, string.ascii_letters + string.digits))
#: Longer runs of punctuation behind a word stay with it.
LONGEST_TAIL = 4
#: Characters after which a sentence can end, and a letter no text of this corpus is likely to hold.
SENTENCE_ENDS = ".!?\n"
RARE = "ⵣ"
ODD = 0


def pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces that make up the texts, and where among them each text begins and the last ends.

    A piece begins at a text's beginning, at a blank or line feed, and where punctuation ends what began so with a Latin letter or
    digit before: both kinds of vocabulary split there.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = np.append(_BREAKS[raw], True)
    begins[ends] = True
    tail = np.flatnonzero(begins)[1:] - 1
    tail = tail[_PUNCTUATION[raw[tail]]]
    for _ in range(LONGEST_TAIL - 1):
        tail -= _PUNCTUATION[raw[tail - 1]] & (tail > 0)
    tail = tail[tail > 1]
    one, two = raw[tail - 1], raw[tail - 2]
    begins[tail[_ALPHANUMERIC[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]] = True
    at = np.flatnonzero(begins).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw)), np.searchsorted(at, ends)


class PieceEncoder:
    """ids of whole texts as arrays of uint32; at most 2 * remembered pieces and those of a slice stay in memory, the latest.

    Vocabularies that drop white space and letter case (word-level ones) are told from byte-level ones by themselves.
    """

    def __init__(self, path: str, remembered: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts that hold one of these go to the library whole: it finds them before it splits anything.
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)", re.IGNORECASE if any(t.normalized for t in added) else 0)
        self.remembered = remembered
        self.drops_blanks = not self._ids(" ")
        self.known: dict[str, bytes | int] = {}
        self.older: dict[str, bytes | int] = {}
        #: The same vocabulary for words of Latin letters, which need no pattern to be parted and no normal form.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        at_blanks = pre_tokenizers.Split(" ", "removed" if self.drops_blanks else "merged_with_next")
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([at_blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.between = f" {RARE} " if self.drops_blanks else "\n"
        self.mark = np.array(self._ids(self.between), np.uint32)
        self.feed = b"" if self.drops_blanks else np.array(self._ids("\n"), np.uint32).tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Which ids end a word (word-level vocabularies mark it) or begin one (byte-level ones write the blank as Ġ).
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if self.drops_blanks else token.startswith("Ġ")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _many(self, stems: list[str]) -> list[bytes]:
        """ids of each stem: all are encoded as one text, between marks that occur in none of them."""
        if not stems:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(stems)], add_special_tokens=False)[0].ids, np.uint32)
        m = len(self.mark)
        hit = np.ones(max(0, len(ids) - m + 1), bool)
        for k in range(m):
            hit &= ids[k : len(ids) - m + 1 + k] == self.mark[k]
        ends = np.flatnonzero(hit)
        raw, starts = ids.tobytes(), [0, *((ends + m) * 4).tolist()]
        if len(ends) != len(stems) - 1:  # can't be; then one by one
            return [np.array(self._ids(s), np.uint32).tobytes() for s in stems]
        return [raw[a:b] for a, b in zip(starts, [*(ends * 4).tolist(), len(raw)], strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of words of Latin letters, each with its blank before it: all are encoded as one text and parted where ids show a word's edge."""
        if not words:
            return []
        text = "".join(words).lower()[1:] if self.drops_blanks else "".join(words)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):  # can't be; then one by one
            return [np.array(self._ids(w), np.uint32).tobytes() for w in words]
        cuts = ([0, *((at + 1) * 4).tolist()]) if self.drops_blanks else [*(at * 4).tolist(), len(ids) * 4]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of each piece; ODD for one that its text can't be cut at."""
        known, words, others = self.known, [], {}
        for p, again in zip(pieces, map(self.older.get, pieces), strict=True):
            if again is not None:
                known[p] = again
            elif _WORD.fullmatch(p):
                words.append(p)
            elif p[0] not in " \n":  # punctuation behind a word, or a text's beginning
                known[p] = np.array(self._ids(p), np.uint32).tobytes()
            elif not _STARTS_PLAIN.match(p[1:] if p[0] == " " else p) or RARE in p:
                known[p] = ODD
            else:  # a stem of a byte-level vocabulary has its blank before it
                others[p] = p[1:].lower() if self.drops_blanks else p.removeprefix("\n")
        known.update(zip(words, self._words(words), strict=True))
        stems = list(dict.fromkeys(others.values()))
        ids = dict(zip(stems, self._many(stems), strict=True))
        known.update((p, self.feed + ids[stem] if p[0] == "\n" else ids[stem]) for p, stem in others.items())

    def _slowly(self, text: str) -> bytes:
        parts = [text] if self.drops_blanks else _CUT.split(text)
        return np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)), np.uint32).tobytes()

    def encode(self, texts: list[str | None] | pa.Array, together: int | None = None) -> Iterator[np.ndarray]:
        """ids of each text. Texts of so many bytes are cut at once; 1 MB, or less if few pieces are remembered."""
        rows = pa.RecordBatch.from_arrays([pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")], ["text"])
        for b in sliced_by_size(iter([rows]), 0, together or min(1 << 20, max(1, 4 * self.remembered))):
            yield from self._some(b.column(0))

    def _some(self, texts: pa.StringArray) -> list[np.ndarray]:
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        parts, bounds = pieces(texts)
        coded = parts.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, different))
        if None in found:
            gap = [k for k, x in enumerate(found) if x is None]
            self._learn([different[k] for k in gap])
            for k in gap:
                found[k] = self.known[different[k]]
        codes, odd = coded.indices.to_numpy(), set()
        if ODD in found:  # pieces that can't be cut off
            can_not = np.array([x is ODD for x in found], bool)
            odd = set((np.searchsorted(bounds, np.flatnonzero(can_not[codes]), "right") - 1).tolist())
            found = [b"" if x is ODD else x for x in found]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ends = np.cumsum(sizes[codes], dtype=np.int32)  # where each piece's ids end among all
        here = (np.cumsum(sizes, dtype=np.int32))[codes] - ends  # from there to its ids among those of different pieces
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(found), np.uint32)[np.repeat(here, sizes[codes]) + np.arange(total, dtype=np.int32)]
        cuts = np.append(np.int32(0), ends)[bounds].tolist()
        out = []
        for i, t in enumerate(texts.to_pylist()):
            if self.special.search(t):
                out.append(np.array(self._ids(t), np.uint32))
            else:
                out.append(np.frombuffer(self._slowly(t), np.uint32) if i in odd else ids[cuts[i] : cuts[i + 1]])
        return out

    def ends_sentence(self) -> np.ndarray:
        """For each id, whether its text ends as a sentence does. Byte-level files write the line feed as Ċ."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            t = token.removesuffix("</w>").replace("Ċ", "\n")
            out[i] = bool(t) and t[-1] in SENTENCE_ENDS
        return out


#: Pieces that an encoder remembers where nothing else is asked for.
REMEMBERED = 600_000


def encoder(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """One for each Python worker: what it remembers serves the next tasks too."""
    return held_by_worker(f"encoder {path} {remembered}", lambda: PieceEncoder(path, remembered))
