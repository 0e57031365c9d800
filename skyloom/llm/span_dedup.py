"""Substring deduplication by sliding spans of sentences and of parts of long sentences.

Each text is cut into sentences (after . ! ? with white space behind, after the full stops of other scripts, and at line
feeds). Sentences of WINDOW words or more are cut further, before the words whose hash is the least of some WINDOW
consecutive words of the sentence. From every piece the shortest run of consecutive pieces that has at least ``words``
words is hashed, and so is the shortest run that ends with it. All runs of all documents meet by hash; runs that aren't
the first of their kind are repeated spans, and every piece that such a span covers goes. A repeated passage goes
entirely if its whole pieces have ``words`` words or more, for each of them lies in a run inside the passage; shorter
common lines stay.

Where a passage of 51 words or more begins and ends doesn't matter: it holds a cut behind at most its first WINDOW - 1
words and one before at most its last WINDOW, and these two and all cuts between depend on its own words only. At least
51 - (2 WINDOW - 1) = 20 words lie in between; only those outside stay. In scripts without blanks each character is a word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .firsts import ROW, repeats
from .shared import beside, quoted, sliced_by_size, table

#: Full stops of other scripts; they end a sentence with or without white space behind.
STOPS = "\u0589\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5\u3002\uff01\uff0e\uff1f\uff61"
#: A sentence with the white space behind it; together they make up the text.
SENTENCE = re.compile(rf"[^.!?\n{STOPS}]*(?:[.!?]+(?!\s)[^.!?\n{STOPS}]*)*[.!?{STOPS}]*\s*")
#: Sentences of so many words are cut further.
WINDOW = 16


def _unspaced() -> tuple[str, str]:
    """The letters of scripts without blanks (Thai to Myanmar, Khmer, kana, Han), and the marks that stand on them."""
    blocks = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF)]
    chars = [chr(c) for a, b in blocks for c in range(a, b + 1)]
    marks = "".join(c for c in chars if unicodedata.category(c)[0] == "M")
    letters = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
    return letters + "\u3005\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff", marks


_LETTERS, _MARKS = _unspaced()
UNSPACED = re.compile(f"[{_LETTERS}]")
WORD = re.compile(r"\S+")
WORD_OR_LETTER = re.compile(rf"[{_LETTERS}][{_MARKS}]*|[^\s{_LETTERS}]+")


def words_of(piece: str) -> list[str]:
    """Its words; of scripts without blanks, its characters."""
    return piece.split() if piece.isascii() or not UNSPACED.search(piece) else WORD_OR_LETTER.findall(piece)


def least(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Where the least of some so many consecutive hashes is; of equal ones, the last."""
    out, m = [], -1
    for r, h in enumerate(hashes):
        if m < 0 or h <= hashes[m]:
            m = r
        elif m <= r - window:
            m = min(range(r, r - window, -1), key=hashes.__getitem__)
        if r >= window - 1 and (not out or out[-1] != m):
            out.append(m)
    return out


def sentences(text: str) -> list[str]:
    """Sentences, the long ones in pieces; together they make up the text."""
    out = []
    for s in SENTENCE.findall(text):
        if len(s) < WINDOW or len(words_of(s)) < WINDOW:
            if s:
                out.append(s)
            continue
        at = [m.start() for m in (WORD if s.isascii() else WORD_OR_LETTER).finditer(s)]
        ends = [*at[1:], len(s)]
        hashes = [xxhash.xxh32_intdigest(s[x:y].rstrip()) for x, y in zip(at, ends, strict=True)]
        cuts = [0, *(at[i] for i in least(hashes) if i), len(s)]
        out += [s[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
    return out


#: The ASCII characters that separate words, and bytes that stand in texts of Latin letters only (to U+017F) or behind such ones.
_BLANK = np.isin(np.arange(256), [ord(c) for c in map(chr, range(128)) if c.isspace()])
_LATIN = np.arange(256) < 0xC0
_LATIN[0xC3:0xC6] = True
_STOP = np.isin(np.arange(256), list(b".!?"))
#: Texts of so many bytes are cut up at once.
TOGETHER = 4 << 20


def raw_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each text begins and the last ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def _latin(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces and words of texts of Latin letters begin: ``sentences`` and ``words_of``, of all texts at once."""
    blank = np.append(_BLANK[raw], True)  # the last stands behind all texts
    begins = ~blank
    begins[1:] &= blank[:-1]
    own = ends[:-1][ends[:-1] < ends[1:]]  # where texts begin that aren't empty
    begins[own] = ~blank[own]
    words = np.flatnonzero(begins)
    if not len(words):
        return own, words
    # A sentence begins with a word of the same text if a stop or a line feed is behind the word before, or a line feed before the first.
    feeds = np.append(0, np.cumsum(raw == 10))
    text_of = np.searchsorted(own, words, "right") - 1
    lasts = np.flatnonzero(blank[1:] & ~blank[:-1])  # where words end, unless at a text's end
    same = text_of[1:] == text_of[:-1]
    before = own[text_of]
    before[1:][same] = lasts[np.searchsorted(lasts, words[1:][same]) - 1] + 1
    opens = feeds[words] > feeds[before]
    opens[1:] |= same & _STOP[raw[before[1:] - 1]]
    opens &= words > own[text_of]
    first = opens.copy()
    first[0] = True
    first[1:] |= ~same
    # The last of the least hashes of any WINDOW consecutive words of a sentence.
    of = np.cumsum(first)
    n = len(words)
    if n >= WINDOW:
        whole = of[WINDOW - 1 :] == of[: n - WINDOW + 1]
        coded = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(words, len(raw)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter((xxhash.xxh32_intdigest(w.rstrip()) for w in different), np.uint64, len(different))
        low = (hashes[coded.indices.to_numpy()] << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
        width = 1
        while width < WINDOW:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        at = n - 1 - (low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        opens[at[~first[at]]] = True
    return np.union1d(own, words[opens]), words


def cut_up(texts: pa.StringArray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """(sizes, counts, digests, bounds) of the pieces of texts without nulls: bytes, words, 16 bytes of hash of the words of each; where
    among them each text begins and the last ends. Without hashed, counts and digests are empty.

    Texts of Latin letters that follow each other are cut as one array, others one by one.
    """
    raw, ends = raw_of(texts)
    odd = np.append(0, np.cumsum(~_LATIN[raw]))
    sizes, counts, digests, numbers = [], [], [], []
    k = 0
    for other, run in groupby((odd[ends[1:]] > odd[ends[:-1]]).tolist()):
        n = len(list(run))
        if other:
            for text in texts.slice(k, n).to_pylist():
                parts = sentences(text)
                sizes.append(np.array([len(p.encode()) for p in parts], np.int64))
                numbers.append(np.array([len(parts)]))
                if hashed:
                    split = [words_of(p) for p in parts]
                    counts.append(np.array([len(p) for p in split], np.int64))
                    digests += [xxhash.xxh3_128_digest(" ".join(p)) for p in split]
        else:
            here, bounds = raw[ends[k] : ends[k + n]], ends[k : k + n + 1] - ends[k]
            at, words = _latin(here, bounds)
            edges = np.append(at, len(here))
            sizes.append(np.diff(edges))
            numbers.append(np.diff(np.searchsorted(at, bounds)))
            if hashed:
                counts.append(np.diff(np.searchsorted(words, edges)))
                plain = np.where(_BLANK[here], np.uint8(32), here).tobytes()
                cut = [plain[x:y].strip(b" ") for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                digests += [xxhash.xxh3_128_digest(p if b"  " not in p else b" ".join(p.split())) for p in cut]
        k += n
    one = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return one(sizes), one(counts), b"".join(digests), np.append(0, np.cumsum(one(numbers)))


def runs(counts: list[int], words: int) -> list[tuple[int, int]]:
    """(start, length) of the shortest runs of at least so many words from each piece on, and up to each."""
    n, total = len(counts), [0]
    for c in counts:
        total.append(total[-1] + c)
    out, j = set(), 0
    for i in range(n):  # forwards
        while j < n and total[j] - total[i] < words:
            j += 1
        if total[j] - total[i] < words:
            break
        out.add((i, j - i))
    i = 0
    for j in range(1, n + 1):  # backwards
        if total[j] < words:
            continue
        while i + 1 < j and total[j] - total[i + 1] >= words:
            i += 1
        out.add((i, j - i))
    return sorted(out)


def runs_of(counts: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the ``runs`` of texts whose pieces stand one behind the other; start counts from the first piece of all."""
    total, n = np.append(0, np.cumsum(counts)), len(counts)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.arange(n)
    end = np.searchsorted(total, total[:-1] + words)
    ahead = end <= bounds[1:][text]
    until = np.arange(1, n + 1)
    since = np.searchsorted(total, total[1:] - words, "right") - 1
    back = since >= bounds[:-1][text]
    both = np.unique(np.concatenate([start[ahead] * (n + 1) + (end - start)[ahead], since[back] * (n + 1) + (until - since)[back]]))
    start, size = both // (n + 1), both % (n + 1)
    return text[start], start, size


def span_keys(docs: DataFrame, words: int = 20) -> DataFrame:
    """Occurrences (ROW) of runs: pos is the first piece, size the number of pieces. Blanks between words don't count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced_by_size(batches, 1, TOGETHER):
            _, counts, digests, bounds = cut_up(b.column(1).cast(pa.string()))
            text, start, size = runs_of(counts, bounds, words)
            raw = b"".join([xxhash.xxh3_128_digest(digests[i:j]) for i, j in zip((start * 16).tolist(), ((start + size) * 16).tolist(), strict=True)])
            h = np.frombuffer(raw, np.int64).reshape(-1, 2)
            doc, at, size = b.column(0).take(pa.array(text)), (start - bounds[text]).astype(np.int32), size.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), doc, pa.array(at), pa.array(size)], ["h1", "h2", "doc_id", "pos", "size"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROW)


def repeated_spans(docs: DataFrame, words: int = 20, parts: int | None = None) -> DataFrame:
    """(doc_id, spans): the repeated runs (start, size in pieces) of each document that has some."""
    gone = repeats(table(span_keys(docs, words), "span-keys"), whole_doc=False, parts=parts)
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "size")).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with text lacking the covered pieces, and columns n_sentences, n_removed (both count pieces), removed: array of
    (start, length) in characters of the old text.

    A null text stays null with no sentences. Other columns stay; those named like the new ones are replaced. Rows with
    equal ids are one document. Rows without an id lose nothing.
    """
    new = ("n_sentences", "n_removed", "removed")
    own = [c for c in docs.columns if c not in new]
    at = own.index("text")
    both = beside(docs, own, spans.select("doc_id", "spans"))
    cuts = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced_by_size(batches, at, TOGETHER):
            old = b.column(at).cast(pa.string())
            filled = pc.fill_null(old, "")
            sizes, _, _, bounds = cut_up(filled, hashed=False)
            raw, ends = raw_of(filled)
            n, totals = len(sizes), np.diff(bounds)
            found = b.column(len(own))
            row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
            pos, many = (found.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "size"))
            held = pos < totals[row]  # rows of one id may have different texts
            row, pos, many = row[held], pos[held], many[held]
            start, stop = bounds[row] + pos, bounds[row] + np.minimum(totals[row], pos + many)
            lost = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:n] > 0
            keep = np.repeat(~lost, sizes)
            left = np.append(0, np.cumsum(keep))[ends].astype(np.int32)
            texts = pa.StringArray.from_buffers(len(b), pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(raw[keep])))
            # Runs of lost pieces of a text, in characters: bytes that don't continue one.
            chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[np.append(0, np.cumsum(sizes))]
            text = np.repeat(np.arange(len(b)), totals)
            fresh = np.append(True, text[1:] != text[:-1])[:n]
            begin = np.flatnonzero(lost & (fresh | ~np.append(False, lost[:-1])[:n]))
            end = np.flatnonzero(lost & np.append((fresh | ~lost)[1:], True)[:n]) + 1
            spots = pa.StructArray.from_arrays([pa.array(chars[begin] - chars[bounds[text[begin]]]), pa.array(chars[end] - chars[begin])], ["start", "length"])
            where = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, bounds).astype(np.int32)), spots)
            gone = np.diff(np.append(0, np.cumsum(lost))[bounds])
            cols = [pc.if_else(old.is_null(), pa.scalar(None, pa.string()), texts) if i == at else b.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(totals), pa.array(gone), where.cast(cuts)], [*own, *new])

    kinds = ", ".join(f"{quoted(c)} {'string' if c == 'text' else t}" for c, t in docs.dtypes if c in own)
    return both.mapInArrow(run, f"{kinds}, n_sentences long, n_removed long, removed array<struct<start:long,length:long>>")


def dedup_spans(docs: DataFrame, words: int = 20, parts: int | None = None) -> DataFrame:
    return remove_spans(docs, repeated_spans(docs, words, parts))
